import random

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from cashtide.operators.star import (
    Lookup,
    _salted,
    aggregate_by_attributes,
    at_latest,
    check_unique,
    salted_lookup,
    side_by_side,
    star_join,
    sums,
)
from cashtide.session import configure


@pytest.fixture
def dim(spark):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(id, name)")


@pytest.fixture
def fact(spark):
    return spark.createDataFrame([(1, 10), (1, 5), (2, 7), (9, 3)], "id int, v int")


def test_unmatched_rows_stay(fact, dim):
    joined = star_join(fact, [Lookup("d", dim, "id", "id")])
    assert sorted(rows(joined.select("fact.v", "d.name")), key=str) == [(10, "a"), (3, None), (5, "a"), (7, "b")]


def test_repeated_keys_are_refused(spark, fact, dim):
    twice = dim.unionByName(spark.createDataFrame([(1, "c")], "id int, name string"))
    check_unique(dim, "id")
    with pytest.raises(ValueError, match="not unique"):
        star_join(fact, [Lookup("d", twice, "id", "id")], check=True)


def grouped(fact, dim, keep=None, grain_first=True):
    found = aggregate_by_attributes(
        fact, [Lookup("d", dim, "id", "id")], [("name", "d.name")], sums(v="v", twice="fact.v * 2"), keep, grain_first=grain_first
    )
    return sorted(rows(found.select("name", "v", "twice")), key=str)


def test_both_ways_of_aggregating_agree(spark, fact, dim, request):
    want = [("a", 15, 30), ("b", 7, 14), (None, 3, 6)]
    for first in (True, False):
        assert grouped(fact, dim, grain_first=first) == sorted(want, key=str)
        assert grouped(fact, dim, F.col("d.name") == "a", first) == [("a", 15, 30)]
    request.getfixturevalue("no_broadcast")
    assert grouped(fact, dim) == sorted(want, key=str)
    assert grouped(fact, dim, F.col("d.name") == "a") == [("a", 15, 30)]


def test_a_hot_key_reaches_the_shuffled_join_as_one_row(spark, dim, no_broadcast):
    rng = random.Random(3)
    data = [(1, 1) for _ in range(4000)] + [(rng.randrange(2, 500), 1) for _ in range(8000)]
    fact = spark.createDataFrame(data, "id int, v int")
    found = aggregate_by_attributes(fact, [Lookup("d", dim, "id", "id")], [("name", "d.name")], sums(v="v"))
    assert dict(rows(found))["a"] == 4000
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    assert "HashAggregate" in join, "the fact is aggregated below the join"


def test_adaptive_execution_splits_a_hot_key(spark, no_broadcast, tmp_path):
    """A plain lookup of raw rows by a key that holds a third of them."""
    configure(spark)
    spark.range(0, 300_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 7L, id) AS id", "repeat(cast(id AS string), 20) AS v"
    ).write.parquet(f"{tmp_path}/fact")
    spark.range(0, 300_000, 1, 8).selectExpr("id", "concat('n', id) AS name").write.parquet(f"{tmp_path}/dim")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        fact, dim = spark.read.parquet(f"{tmp_path}/fact"), spark.read.parquet(f"{tmp_path}/dim")
        joined = star_join(fact, [Lookup("d", dim, "id", "id")]).selectExpr("d.name AS name", "length(fact.v) AS n")
        counted = joined.groupBy("name").agg(F.count("*").alias("n"), F.sum("n").alias("total"))
        assert counted.filter("name = 'n7'").first().n >= 100_000
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_latest(spark):
    df = spark.createDataFrame([(day("2026-10-24"), 1), (day("2026-10-31"), 2), (day("2026-10-31"), 3)], "w date, v int")
    assert sorted(rows(at_latest(df, "w").select("v"))) == [(2,), (3,)]
    assert rows(at_latest(df, "w", day("2026-10-24")).select("v")) == [(1,)]


def test_side_by_side(spark):
    one = spark.createDataFrame([(1,)], "a int")
    two = spark.createDataFrame([(None, "x")], "b int, c string")
    assert rows(side_by_side([one, two])) == [(1, None, "x")]


def test_a_repeated_key_is_refused(spark, fact, dim):
    twice = dim.union(dim)
    for first in (True, False):
        with pytest.raises(Exception, match="not unique"):
            grouped(fact, twice, grain_first=first)
    nothing = dim.union(spark.createDataFrame([(None, "x"), (None, "y")], "id int, name string"))
    assert grouped(fact, nothing) == grouped(fact, dim)


def test_salted_lookup(spark, fact, dim):
    found = salted_lookup(fact, Lookup("d", dim, "id", "id"), ["name"], 5)
    plain = fact.join(dim, "id", "left").select(*fact.columns, "name")
    assert found.columns == plain.columns
    assert sorted(rows(found), key=str) == sorted(rows(plain), key=str)


def test_only_hot_keys_are_repeated(spark, no_broadcast):
    """The dimension that reaches the join has a row a key, and one a part of each hot key."""
    fact = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id END AS id", "id AS v")
    dim = spark.range(5000).selectExpr("id", "concat('n', id) AS name")
    spread, repeated = _salted(fact, dim, "id", "id", 32)
    assert repeated.count() == 5000 + 31
    parts = {r.id: r.n for r in spread.groupBy("id").agg(F.countDistinct("__salt").alias("n")).collect()}
    assert parts.pop(7) == 32 and parts.pop(None) == 32 and set(parts.values()) == {1}
    found = salted_lookup(fact, Lookup("d", dim, "id", "id"), ["name"])
    plain = fact.join(dim, "id", "left").select(*fact.columns, "name")
    assert found.exceptAll(plain).count() == 0 and found.count() == 9000
