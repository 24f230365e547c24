import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import day, rows

from cashtide.operators.ordered import (
    daily_balance,
    daily_change,
    daily_fill,
    fill_nulls,
    ordinal_fraction,
    position,
    running_total,
    trailing_share,
)


@pytest.fixture(scope="module")
def raw():
    """One group holds a third of the rows and spans many slices."""
    rng = random.Random(11)
    keys = rng.sample(range(10_000), 900)
    return [("hot" if n % 3 == 0 else rng.choice([None, f"g{rng.randrange(40)}"]), k, rng.randrange(-50, 50), rng.choice([None, None, f"v{k}"])) for n, k in enumerate(keys)]


def frame(spark, raw):
    return spark.createDataFrame(raw, "g string, k int, v int, s string").repartition(5)


@pytest.mark.parametrize("slices", [None, 1, 7, 40])
def test_running_total(spark, raw, slices):
    want, sums = {}, {}
    for g, k, v, _ in sorted(raw, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + v
        want[g, k] = sums[g]
    got = running_total(frame(spark, raw), "v", ["g"], "k", "t", slices)
    assert got.columns == ["g", "k", "v", "s", "t"]
    assert {(r.g, r.k): r.t for r in got.collect()} == want


def test_slices_merged_at_run_time_stay_in_order(spark):
    """Enough rows for several merged slices of different sizes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40KB")
    try:
        df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 11)) AS g", "(id * 7919) % 60000 AS k", "1L AS v")
        got = running_total(df, "v", ["g"], "k", "t")
        wrong = got.selectExpr("t - row_number() OVER (PARTITION BY g ORDER BY k) AS off").filter("off <> 0")
        assert got.count() == 60_000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_position(spark, raw):
    want, n = {}, {}
    for g, k, *_ in sorted(raw, key=lambda r: r[1]):
        n[g] = n.get(g, 0) + 1
        want[g, k] = n[g]
    assert {(r.g, r.k): r.p for r in position(frame(spark, raw), ["g"], "k", "p", 9).collect()} == want


@pytest.mark.parametrize("forward", [True, False])
def test_fill_nulls(spark, raw, forward):
    want, seen = {}, {}
    for g, k, _, s in sorted(raw, key=lambda r: r[1], reverse=not forward):
        seen[g] = s if s is not None else seen.get(g)
        want[g, k] = seen[g]
    got = fill_nulls(frame(spark, raw), "s", ["g"], "k", forward, 9)
    assert got.columns == ["g", "k", "v", "s"]
    assert {(r.g, r.k): r.s for r in got.collect()} == want


def test_fill_of_an_empty_group(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "g string, k int, s string")
    assert sorted(rows(fill_nulls(df, "s", ["g"], "k"))) == [("a", 1, None), ("a", 2, None)]


def test_a_day_has_one_balance(spark):
    data = [(day("2026-01-01"), "in", 10), (day("2026-01-01"), "out", -4), (day("2026-01-02"), "in", 1)]
    df = spark.createDataFrame([(d, c, Decimal(v)) for d, c, v in data], "d date, c string, net decimal(12,2)")
    got = daily_balance(df, "d", "net", name="b")
    assert sorted((r.c, int(r.b)) for r in got.collect()) == [("in", 6), ("in", 7), ("out", 6)]
    change = daily_change(got.select("d", "b").distinct(), "d", "b")
    assert sorted(rows(change.select("d", "change")), key=str) == [
        (day("2026-01-01"), None),
        (day("2026-01-02"), Decimal("1.00")),
    ]


def test_random_balances(spark):
    rng = random.Random(5)
    data = [(dt.date(2026, 1, 1) + dt.timedelta(days=rng.randrange(60)), Decimal(rng.randrange(-9999, 9999)) / 100) for _ in range(400)]
    df = spark.createDataFrame(data, "d date, net decimal(12,2)").groupBy("d").agg({"net": "sum"}).toDF("d", "net")
    for r in daily_balance(df, "d", "net").collect():
        assert r.balance == sum(v for d, v in data if d <= r.d)


def test_daily_fill(spark):
    values = [None, 1, None, 3, None]
    df = spark.createDataFrame([(day(f"2026-01-0{n + 1}"), v) for n, v in enumerate(values)], "d date, v int")

    def filled(**how):
        return [r.v for r in daily_fill(df, "d", "v", **how).orderBy("d").collect()]

    assert filled() == [1, 1, 1, 3, 3]
    assert filled(backward_first=True) == [1, 1, 3, 3, 3]
    empty = spark.createDataFrame([(day("2026-01-01"), None)], "d date, v int")
    assert rows(daily_fill(empty, "d", "v")) == [(day("2026-01-01"), None)]


def test_ordinal_fraction(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "g string, k int")
    assert sorted(rows(ordinal_fraction(df, ["g"], "k").select("g", "k", "fraction"))) == [
        ("a", 1, 0.5),
        ("a", 5, 1.0),
        ("b", 2, 1.0),
    ]


@pytest.mark.parametrize("slices", [1, 5, 10])
def test_running_total_where_values_are_missing(spark, slices):
    data = [("a", n, 5 if 3 <= n < 10 else None) for n in range(20)] + [("b", n, None) for n in range(6)]
    df = spark.createDataFrame(data, "g string, k int, v int")
    got = {(r.g, r.k): r.total for r in running_total(df, "v", ["g"], "k", "total", slices).collect()}
    want = {(g, k): None if g == "b" or k < 3 else 5 * (min(k, 9) - 2) for g, k, _ in data}
    assert got == want


def test_trailing_share_forgets_and_guards(spark):
    data = [("IN", 1, "a", 30), ("IN", 1, "b", 10), ("IN", 5, "b", 10), ("IN", 10, "a", 5), ("IN", 10, "b", -5), ("OUT", 5, "c", 7)]
    df = spark.createDataFrame([(d, day(f"2026-01-{n:02d}"), c, Decimal(v)) for d, n, c, v in data], "side string, day date, who string, v decimal(28,2)")
    got = {(r.side, r.day.day, r.who): r.share for r in trailing_share(df, "day", "v", "who", 5, ["side"]).collect()}
    # On the tenth, only that day is within five days, and its amounts cancel.
    assert got == {("IN", 1, "a"): 0.75, ("IN", 1, "b"): 0.25, ("IN", 5, "b"): 0.4, ("IN", 10, "a"): None, ("IN", 10, "b"): None, ("OUT", 5, "c"): 1.0}
