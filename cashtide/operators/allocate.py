"""Splitting totals over rows so that the parts add up to the total again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, portion_sql
from cashtide.operators.ordered import position
from cashtide.operators.star import join_groups


def allocate_exact(
    rows: DataFrame, totals: DataFrame, total: str, weight: str, by: Sequence[str], key: str, name: str = "allocated"
) -> DataFrame:
    """Split each group's total in proportion to its rows' weights, to the cent.

    Rounding differences go to the row with the highest ``key``, unique in its group. Two grouped
    sums and joins replace a window per group, so no task ever holds a whole group.
    """
    weights = rows.groupBy(*by).agg(F.sum(weight).alias("__whole"))
    targets = join_groups(totals.select(*by, F.col(total).cast(TOTAL).alias("__total")), weights, by)
    # Both weights in hundredths let the shares be computed in whole numbers.
    share = portion_sql("__total", f"{weight} * 100", "__whole * 100")
    shares = join_groups(rows, targets, by).withColumn(name, F.expr(f"coalesce({share}, CAST(0 AS {TOTAL}))"))
    leftover = shares.groupBy(*by).agg(
        (F.max("__total") - F.sum(name)).cast(TOTAL).alias("__leftover"), F.max(key).alias(key)
    )
    return (
        join_groups(shares, leftover, [*by, key], "left")
        .withColumn(name, (F.col(name) + F.coalesce("__leftover", F.lit(0))).cast(TOTAL))
        .select(*rows.columns, name)
    )


def even_split(
    rows: DataFrame,
    totals: DataFrame,
    total: str,
    by: Sequence[str],
    key: str,
    name: str = "units",
    slices: int | None = None,
) -> DataFrame:
    """Split each group's whole-number total evenly; its first rows by ``key`` take one more each."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    targets = join_groups(totals.select(*by, F.col(total).cast("bigint").alias("__total")), sizes, by)
    extra = F.pmod("__total", "__n")
    base = F.call_function("div", F.col("__total") - extra, F.col("__n"))
    ranked = position(rows, by, key, "__position", slices)
    return (
        join_groups(ranked, targets, by)
        .withColumn(name, base + F.when(F.col("__position") <= extra, 1).otherwise(0))
        .select(*rows.columns, name)
    )


def split_by_share(df: DataFrame, amount: str, shares: Mapping[str, str], name: str, label: str) -> DataFrame:
    """Each amount over fixed shares (decimal text by label), each part rounded to the cent."""
    parts = ", ".join(
        f"named_struct('{label}', '{who}', '{name}', CAST(round({amount} * CAST('{share}' AS DECIMAL(6,4)), 2) AS {TOTAL}))"
        for who, share in shares.items()
    )
    kept = [c for c in df.columns if c != amount]
    return df.selectExpr(*kept, f"inline(array({parts}))")
