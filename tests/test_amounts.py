import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cashtide.functions.amounts import (
    AGE_BOUNDS,
    AGE_LABELS,
    bucketize,
    padded_id,
    portion,
    ratio,
    swap_prefix,
    total,
    total_or_zero,
)


def test_bands_close_above(spark):
    df = spark.createDataFrame([(n,) for n in (0, 30, 31, 60, 61, 90, 91)] + [(None,)], "n int")
    got = [r[0] for r in rows(df.select(bucketize("n", AGE_BOUNDS, AGE_LABELS)))]
    assert got == ["0-30", "0-30", "31-60", "31-60", "61-90", "61-90", "90+", None]


def test_bands_need_one_label_more_than_bounds():
    with pytest.raises(ValueError):
        bucketize("n", (1, 2), ("a", "b"))


def test_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    assert rows(df.select(ratio("a", "b", 3))) == [(None,), (0.25,)]


def test_totals_without_rows(spark):
    df = spark.createDataFrame([(Decimal("1.10"), "x"), (Decimal("2.20"), "x")], "v decimal(12,2), k string")
    got = df.agg(total("v").alias("a"), total("v", "k = 'y'").alias("b"), total_or_zero("v", "k = 'y'").alias("c")).first()
    assert tuple(got) == (Decimal("3.30"), None, Decimal("0.00"))


def test_portion_rounds_halves_away_from_zero(spark):
    rng = random.Random(7)
    cases = [(Decimal("0.05"), 1, 2), (Decimal("-0.05"), 1, 2), (Decimal("10.00"), 1, 3), (Decimal("1.00"), 0, 5)]
    cases += [
        (Decimal(rng.randrange(-(10**12), 10**12)) / 100, rng.randrange(0, 10**6), rng.randrange(1, 10**6))
        for _ in range(300)
    ]
    df = spark.createDataFrame(cases, "a decimal(28,2), p bigint, w bigint")
    for amount, part, whole, got in rows(df.select("*", portion("a", "p", "w"))):
        want = (amount * part / Decimal(whole)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert got == want, (amount, part, whole)


def test_portion_of_zero_is_null(spark):
    df = spark.createDataFrame([(Decimal("1.00"), 1, 0)], "a decimal(28,2), p int, w int")
    assert rows(df.select(portion("a", "p", "w"))) == [(None,)]


def test_ids(spark):
    df = spark.createDataFrame([(42,)], "n int").select(padded_id("SKU", "n", 5).alias("id"))
    assert rows(df.select("id", swap_prefix(F.col("id"), "SKU", "INV"))) == [("SKU-00042", "INV-00042")]
