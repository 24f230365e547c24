import numpy as np
import pytest

from cashtide.llm import rules
from cashtide.llm.queries import op12_quality_classifier
from cashtide.llm.toxicity import held_out


def plainly(text):
    """The statistics of one text in plain Python."""
    blank = " \t\n\x0b\x0c\r"
    words = text.lower().encode().split()
    words = [w.decode() for w in words]
    cased = [w.decode() for w in text.encode().split()]
    lines = text.split("\n")
    sign = lambda c: ord(c) < 128 and c not in blank and not c.isalnum()
    runs = sum(sign(a) and sign(b) and not (i and sign(text[i - 1])) for i, (a, b) in enumerate(zip(text, text[1:], strict=False)))
    n, chars = len(words), len(text)
    over = lambda a, b: a / b if b else 0.0
    stops = sum(w[-1] in ".!?" for w in cased)
    return [
        n,
        over(sum(map(len, cased)), n),
        n / len(lines),
        n / (stops + 1),
        over(sum("A" <= c <= "Z" for c in text), chars),
        over(sum("0" <= c <= "9" for c in text), chars),
        over(sum(map(sign, text)), chars),
        over(runs, n),
        over(sum(all(map(sign, w)) for w in cased), n),
        over(sum(len(w) <= 3 for w in cased), n),
        over(sum(len(w) >= 14 for w in cased), n),
        over(stops, n),
        over(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        over(len(set(words)), n),
        over(max((words.count(w) for w in set(words)), default=0), n),
        len(set(lines)) / len(lines),
    ]


TEXTS = [
    "", " \n ", "One two two. THREE!!\nOne two two. THREE!!", "a | b | c $$$ 12 3,4 &&&x\n\n\n", "É ü naïve ß. same same SAME same",
    "x" * 40 + " " + "x" * 40, "\x00\x1f odd \x7f", "日本語の 文", "end.\n", "\n",
]


def test_statistics_are_as_defined(spark, awkward):
    got = rules.measures(TEXTS)
    assert np.allclose(got, [plainly(t) for t in TEXTS])
    rows = rules.statistics(awkward(list(enumerate(TEXTS))), "doc_id", "text").collect()
    assert np.allclose(sorted(tuple(r)[1:] for r in rows), sorted(map(tuple, got)))


def test_a_lasso_keeps_the_rules_that_matter():
    draw = np.random.default_rng(1)
    x = draw.random((2000, len(rules.NAMES)))
    y = ((x[:, 6] <= 0.3) & (x[:, 13] > 0.5)).astype(int)
    model = rules.train(x, y)
    heaviest = max(zip(model.weights, model.rules, strict=True), key=lambda r: abs(r[0]))[1]
    assert {c[0] for c in heaviest} == {6, 13}
    fresh = draw.random((2000, len(rules.NAMES)))
    met = [rules._meets(fresh, rule) for rule in model.rules]
    score = np.stack(met, axis=1) @ np.array(model.weights) + model.intercept
    assert ((score > 0) == ((fresh[:, 6] <= 0.3) & (fresh[:, 13] > 0.5))).mean() > 0.97
    assert len(model.rules) < 120
    assert model.trained == 2000


def test_the_expression_scores_as_the_rules_say(spark):
    draw = np.random.default_rng(3)
    x = draw.random((400, len(rules.NAMES))).round(2)
    model = rules.train(x, (x[:, 4] + x[:, 12] > 1).astype(int), trees=10)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], list(rules.NAMES))
    got = [r[0] for r in frame.select(model.column()).collect()]
    met = [sum(w for rule, w in zip(model.rules, model.weights, strict=True)
               if all(row[s] <= b if below else row[s] > b for s, below, b in rule)) for row in x]
    assert np.allclose(got, 1 / (1 + np.exp(-(np.array(met) + model.intercept))))
    said = frame.select(model.fired().alias("r")).first()["r"]
    holding = [t for t, rule in zip(model.texts(), model.rules, strict=True) if all((x[0][s] <= b) == below for s, below, b in rule)]
    assert sorted(said) == sorted(holding)


@pytest.mark.parametrize(("y", "low", "high"), [([], 0.5, 0.5), ([1, 1, 1], 0.8, 1.0), ([0, 0], 0.0, 0.2)])
def test_without_both_labels_all_score_the_same(spark, awkward, y, low, high):
    model = rules.train(np.zeros((len(y), len(rules.NAMES))), np.array(y, dtype=float))
    docs = awkward([(1, None), (1, ""), (None, "Some text."), (2, "word " * 200_000)])
    got = rules.rate(docs, model, reasons=True).collect()
    assert len(got) == 4
    assert all(low <= r["score"] <= high and r["reasons"] == [] for r in got)
    assert rules.rate(awkward([]), model).count() == 0


def test_held_out_documents_are_told_apart(spark):
    sample = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sample}/labels.parquet").where(held_out("doc_id"))
    found = op12_quality_classifier(spark, sample)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels, "doc_id").select("held_out", "quality", "predicted", "score").collect()
    assert all(r["held_out"] and 0 <= r["score"] <= 1 for r in rows)
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] == 0 for r in bad) >= 0.9 * len(bad)
    assert sum(r["predicted"] == 1 for r in good) >= 0.97 * len(good)


def test_labels_that_are_held_out_teach_nothing(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    labels = spark.read.parquet(f"{sample}/labels.parquet")
    turned = labels.selectExpr("doc_id", "1 - quality AS quality").where(held_out("doc_id"))
    known = labels.select("doc_id", "quality").where(~held_out("doc_id"))
    assert rules.fit(docs, known.union(turned)) == rules.fit(docs, known)
    ids = rules.training_rows(docs, labels, "doc_id", "text", "quality", 100)
    assert 40 < ids.count() < 160
    assert ids.where(held_out("id")).isEmpty()
