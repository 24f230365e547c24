import itertools
import random

import numpy as np

from cashtide.llm.common import table
from cashtide.llm.toxicity import fit, forward_backward, held_out, lowered, tag, tokens, train, training_rows, without_toxic


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(2)
    moves, start = np.exp(draw.standard_normal((2, 2))), np.exp(draw.standard_normal(2))
    lengths = [1, 3, 7, 2, 9]
    scores = draw.standard_normal(sum(lengths)) * 2
    first = np.zeros(len(scores), dtype=bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    f, b, _ = forward_backward(scores, first, moves, start)
    found = f * b / (f * b + (1 - f) * (1 - b))
    at = 0
    for n in lengths:
        total, one = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            weight = start[y[0]] * np.prod([moves[p, q] for p, q in itertools.pairwise(y)]) * np.exp(np.dot(y, scores[at : at + n]))
            total += weight
            one += weight * np.array(y)
        assert np.allclose(found[at : at + n], one / total)
        at += n


def test_long_chains_cross_lanes():
    draw = np.random.default_rng(4)
    scores, first = draw.standard_normal(1000), np.zeros(1000, dtype=bool)
    first[[0, 400, 401]] = True
    moves, start = np.array([[1.0, 0.3], [0.5, 2.0]]), np.array([1.0, 0.1])
    f, b, _ = forward_backward(scores, first, moves, start)
    for a, z in ((0, 400), (400, 401), (401, 1000)):
        g, h, _ = forward_backward(scores[a:z], first[a:z], moves, start)
        assert np.allclose(f[a:z] * b[a:z] / (f[a:z] * b[a:z] + (1 - f[a:z]) * (1 - b[a:z])), g * h / (g * h + (1 - g) * (1 - h)))


def corpus(n, seed):
    draw = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(draw.choices("abcdeghinorstu", k=draw.randint(2, 8))) for _ in range(draw.randint(3, 60))]
        toxic = int(draw.random() < 0.25)
        if toxic:
            for _ in range(draw.randint(1, 3)):
                words.insert(draw.randint(0, len(words)), draw.choice(["Blarg", "zonk!", "quelffix", "quelffen"]))
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, labels


def test_learns_words_and_beginnings():
    texts, labels = corpus(900, 1)
    field = train(texts, labels)
    late, marks = corpus(300, 2)
    t = tokens(late)
    p = field.marginals(t)
    assert ((field.scores(t, p) >= 0.5) == np.array(marks)).mean() > 0.97


def test_awkward_rows(spark, awkward):
    texts, labels = corpus(500, 3)
    field = train(texts, labels)
    rows = [(1, None), (2, ""), (3, "é ü Zonk, zonk! Blarg"), (3, "é ü Zonk, zonk! Blarg"), (None, "calm"), (4, "İstanbul blarg " * 30_000), (5, "123 !!")]
    docs = awkward(rows)
    found = tag(docs, field).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    text = dict(rows)[3]
    assert [text[a:b] for a, b in zip(by_id[3].starts, by_id[3].ends, strict=True)] == ["Zonk", "zonk", "Blarg"]
    assert by_id[1].score == by_id[2].score < 0.5 and by_id[1].starts == []
    assert len(by_id[4].starts) == 30_000
    kept = without_toxic(docs, field)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5]
    assert tag(awkward([]), field).count() == 0


def test_no_labels_score_nothing(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    field = fit(awkward([(1, "a")]), labels)
    assert [r.score for r in tag(awkward([(1, "a")]), field).collect()] == [0.0]


def test_held_out_rows_do_not_train(spark, sample):
    docs, labels = table(spark, sample, "documents"), table(spark, sample, "labels")
    used = training_rows(docs, labels, "doc_id", "text", "toxic", 6000, 20_000)
    assert used.count() > 0 and used.where(held_out("doc_id")).count() == 0


def test_lower_case_keeps_lengths():
    assert lowered("ABC İ É") == "abc İ é" and len(lowered("İİ")) == 2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = tag(docs, fit(docs, labels)).join(labels, "doc_id").where(held_out("doc_id"))
    right = [(r.score >= 0.5) == (r.toxic == 1) for r in scored.collect()]
    assert sum(right) / len(right) > 0.9
