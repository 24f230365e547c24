import numpy as np
import pytest

from cashtide.llm.common import table
from cashtide.llm.embeddings import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, u string, keys string, copies int"


def brute(rows, least=0.9):
    usable = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None for x in v):
            continue
        a = np.array(v, dtype=np.float64)
        if np.isfinite(a).all() and a.any():
            a = a / np.abs(a).max()
            usable[i] = a / np.linalg.norm(a)
    ids = sorted(usable)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, links[i], None if i is None else find(i)) for i, _ in rows), key=str)


def result(df):
    found = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id if hasattr(r, "doc_id") else r.vec_id == r.component_id) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str)


@pytest.mark.parametrize("part", [512, 7])
def test_clusters_against_brute_force(spark, part):
    draw = np.random.default_rng(3)
    rows = []
    for _ in range(8):
        base = draw.standard_normal(24)
        for _ in range(int(draw.integers(1, 30))):
            rows.append((len(rows), (base + 0.04 * draw.standard_normal(24)).tolist()))
    rows += [(len(rows) + k, [2 * x for x in rows[5][1]]) for k in range(4)]  # the same direction
    df = spark.createDataFrame([(*r, 0, "x", "y", 1) for r in rows], SCHEMA)
    assert result(near_vectors(df, part=part)) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1e-300, 0.0]), (9, [1e300, 1e299]), (10, [1.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x", "y", 1) for r in rows], SCHEMA)
    assert result(near_vectors(df)) == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_on_given_vectors(spark, sample):
    vectors = table(spark, sample, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    near = [(1000 + i, (np.array(v) + 0.02 * np.random.default_rng(i).standard_normal(len(v))).tolist()) for i, v in rows[:100]]
    df = spark.createDataFrame(rows + near, "vec_id long, embedding array<double>")
    assert result(near_vectors(df)) == brute(rows + near)


def brute_vectors(rows, least=0.9):
    """As ``brute`` where ids repeat: of each (id, direction) one vector, and an answer for every row."""
    unit = [tuple(np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())) for _, v in rows]
    once = sorted({(i, u) for (i, _), u in zip(rows, unit, strict=True)})
    near = np.array([u for _, u in once]) @ np.array([u for _, u in once]).T >= least
    low = np.array([i for i, _ in once])
    for _ in once:
        low = np.where(near, low, low.max()).min(axis=1)
    answer = {x: (int(near[n].sum()) - 1, int(low[n])) for n, x in enumerate(once)}
    return sorted(((i, *answer[i, u]) for (i, _), u in zip(rows, unit, strict=True)), key=str)


@pytest.mark.parametrize("part", [512, 7])
def test_repeated_ids_against_brute_force(spark, part):
    draw = np.random.default_rng(5)
    bases = draw.standard_normal((6, 24))
    rows = [(100 - n, (bases[n % 6] + 0.04 * draw.standard_normal(24)).tolist()) for n in range(60)]
    rows += [rows[3]] * 4 + [rows[59]] * 2  # whole rows again; 59 is the smallest id
    rows += [(rows[3][0], [4 * x for x in rows[3][1]])]  # the same direction
    rows += [(41, bases[k].tolist()) for k in (0, 1, 5)]  # one id with vectors of several groups, the smallest of them
    rows += [(7, rows[10][1]), (7, rows[11][1]), (8, rows[10][1]), (8, (-bases[2]).tolist()), (8, bases[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert result(near_vectors(df, part=part)) == brute_vectors(rows)


def test_repeated_row_keeps_its_number(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (3, None), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(near_vectors(df)) == sorted([(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3), (3, 0, 3), (None, 0, None)], key=str)
