import random
import re

import numpy as np
import pytest

from cashtide.llm import near_dedup as module
from cashtide.llm.common import components, table
from cashtide.llm.near_dedup import _counts, near_dedup, without_near_copies
from cashtide.llm.shingles import MinMax, common, shingle_sets

_FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, words, percent=80):
    """All pairs with a shingle in common, on sets of word tuples."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_FOLD))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    seen = {}
    for n, s in enumerate(sets):
        both = {}
        for x in s:
            for m in seen.get(x, ()):
                both[m] = both.get(m, 0) + 1
            seen.setdefault(x, []).append(n)
        for m, c in both.items():
            a, b = rows[n][0], rows[m][0]
            if a is not None and b is not None and 100 * c >= percent * (len(s) + len(sets[m]) - c):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def result(df):
    found = df.collect()
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in found)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


def edited(draw, words, share):
    return " ".join(draw.choice("uvwxyz") + str(draw.random()) if draw.random() < share else w for w in words)


@pytest.mark.parametrize(("words", "part"), [(2, 500_000), (2, 400), (5, 500_000)])
def test_families_against_brute_force(awkward, words, part):
    draw = random.Random(words)
    rows = []
    for family in range(6):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(8, 90))]
        for _ in range(draw.randint(1, 25)):
            rows.append((len(rows), edited(draw, base, draw.choice([0, 0.01, 0.04, 0.08]))))
    rows += [(1000 + i, "one") for i in range(3)] + [(2000, "ONE"), (2001, "one two"), (2002, "one  two"), (2003, None), (2004, "")]
    draw.shuffle(rows)
    found = near_dedup(awkward(rows).repartition(3), words=words, stray_part=part, part=part)
    assert result(found) == brute(rows, words)


def test_shared_boilerplate_forms_no_pairs_of_a_bucket(awkward, monkeypatch):
    """Many documents at a similarity of about 0.5, of which few are linked: rows to compare stay near the documents' number."""
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(500)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 500, 25)]
    pairs = []

    def spy(candidates, *args, confirmed=module._confirmed):
        pairs.append(candidates.count())
        return confirmed(candidates, *args)

    monkeypatch.setattr(module, "_confirmed", spy)
    assert result(near_dedup(awkward(rows), words=2, few_most=2)) == brute(rows, 2)
    assert sum(pairs) < 6 * len(rows), pairs


def test_awkward_rows(awkward):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, long), (4, long + " end"), (None, "a b c"), (5, "a b c"), (6, "A b c"), (6, "A b c"), (7, "x y"), (7, "p q r")]
    expected = [(1, 0, 1), (2, 0, 2), (3, 39_999, 3), (4, 40_000, 3), (5, 2, 5), (6, 2, 5), (6, 2, 5), (7, 1, 7), (7, 2, 7), (None, 2, None)]
    assert result(near_dedup(awkward(rows), words=2)) == sorted(expected, key=str)
    assert near_dedup(awkward([])).count() == 0


def test_without_near_copies_keeps_columns(awkward):
    docs = awkward([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words that stand here now"), (None, "a b c d e f g"), (4, None)])
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted(docs.where("doc_id is null or doc_id <> 2").select("doc_id").collect(), key=str)


def test_given_tables(spark, sample):
    docs = table(spark, sample, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_dedup(docs, words=2)) == brute(rows, 2)


def test_min_max_is_unbiased():
    draw = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        both = np.unique(draw.integers(0, 1 << 62, 100, dtype=np.uint64))
        a, b = both[:90], both[10:]
        keys = MinMax(rows=1, bands=64).keys([np.sort(a), np.sort(b)])
        agree.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_counts_by_parts():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, 30, dtype=np.uint64)) for _ in range(12)]
    found = _counts(sets[:5], sets[5:], columns=7)
    assert found.tolist() == [[common(a, b) for b in sets[5:]] for a in sets[:5]]


def test_sets_of_few_words():
    sizes = [len(s) for s in shingle_sets(["", "a", "a b", "a b c", "a b a b"], 2)]
    assert sizes == [0, 1, 1, 2, 2]
    same = list(shingle_sets(["A b", "a\tB", "a c", "a"], 5))
    assert same[0] == same[1] and same[0] != same[2] and same[2] != same[3]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(300, 300), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 150))
    assert found.get(300, 300) == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_with_several_texts_in_any_order(awkward):
    """One id links what its texts link, whichever row comes first."""
    draw = random.Random(8)
    one, two, three = (" ".join(f"{k}{n}" for n in range(40)) for k in "abc")
    rows = [(6, one), (5, one + " x"), (6, two), (7, two + " y"), (9, three), (9, ""), (8, three), (None, one), (9, three), (4, "alone")]
    want = brute(rows, 5)
    assert {r[2] for r in want if r[0] in (5, 6, 7)} == {5}
    for _ in range(2):
        draw.shuffle(rows)
        assert result(near_dedup(awkward(rows).repartition(3))) == want
    kept = without_near_copies(awkward(rows))
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == [4, 5, 8, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_against_brute_force(awkward, seed):
    draw = random.Random(seed)
    bases = [[f"w{draw.randint(0, 400)}" for _ in range(draw.randint(8, 60))] for _ in range(12)]
    rows = [(draw.randrange(40), edited(draw, draw.choice(bases), draw.choice([0, 0.02, 0.5]))) for _ in range(120)]
    assert result(near_dedup(awkward(rows), words=2)) == brute(rows, 2)


def test_columns_called_like_helpers_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 7), (2, "a b c", 8)], "doc_id long, text string, __GONE int")
    assert [tuple(r) for r in without_near_copies(docs).collect()] == [(1, "a b c", 7)]


def test_blocks_of_one_leader_are_dealt_out(spark):
    """Also where the join on the leader before them becomes a broadcast at run time."""
    sets = spark.range(400).selectExpr("id AS doc_id", "50L AS n_shingles", "CAST(repeat('abcdefgh', 50) AS BINARY) AS shingles")
    grouped = spark.range(400).selectExpr("0L AS leader", "id AS doc_id", "id % 2 = 0 AS stray")
    found = module._group_links(grouped, sets, 80, 500, 500)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    before = plan[plan.index("FlatMapGroupsInPandas") :]
    before = before[: before.index("Union")]
    assert "hashpartitioning(leader" in before and ", j" in before
