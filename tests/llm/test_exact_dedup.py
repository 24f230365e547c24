import hashlib
import random
import re

import pytest

from cashtide.llm.exact_dedup import exact_dedup, without_copies


def expected(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(bare, []).append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[4], best[4], len(members), m is best, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("fan", "lanes"), [(2, 8), (4, 4), (4, 20), (3, 1)])
def test_against_brute_force(awkward, fan, lanes):
    draw = random.Random(fan * lanes)
    rows = [(i, "".join(draw.choices(["a", "b", " ", "\t", "\n", "ü", " "], k=draw.randint(0, 4)))) for i in range(300)]
    assert result(exact_dedup(awkward(rows).repartition(7), fan=fan, lanes=lanes)) == expected(rows)


def test_awkward_rows(awkward):
    long = "word " * 100_000
    rows = [(1, None), (2, ""), (3, " \t"), (4, long), (5, long + " "), (None, "x y"), (7, "xy"), (None, "xy"), (8, "q"), (8, "q")]
    assert result(exact_dedup(awkward(rows).coalesce(1))) == expected(rows)
    assert exact_dedup(awkward([])).count() == 0


def test_hot_group_is_one_row_per_task(awkward):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)]
    found = exact_dedup(awkward(rows).repartition(5))
    assert found.where("kept").count() == 201
    assert found.where("group_size = 400 and keep_id = 1").count() == 400


def test_without_copies_keeps_columns(awkward):
    docs = awkward([(2, "a b"), (1, "ab"), (1, "ab"), (None, "c"), (5, "c "), (6, None)])
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a b"), (5, "c "), (6, None)]


def test_columns_called_like_helpers_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 1), (2, "ab", 8, 2), (3, "c", 9, 3)], "doc_id long, text string, __ROW int, __row_ int")
    assert sorted(tuple(r) for r in without_copies(docs).collect()) == [(1, "a b", 7, 1), (3, "c", 9, 3)]
