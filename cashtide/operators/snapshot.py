"""Weekly stock snapshots from receipts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashtide.functions.amounts import AGE_BOUNDS, AGE_LABELS, TOTAL, band_sql
from cashtide.functions.dates import date_sql
from cashtide.operators.star import Lookup, Partial, aggregate_by_attributes, unique_by

def _bucketed(rows: DataFrame, date: str, weeks: Sequence[dt.date]) -> DataFrame:
    """Rows up to the last week with ``__week``, the number of the first week on or after their day."""
    whens = " ".join(f"WHEN {date} <= {date_sql(week)} THEN {n}" for n, week in enumerate(weeks[:-1]))
    number = f"CASE {whens} ELSE {len(weeks) - 1} END" if whens else "0"
    return rows.filter(f"{date} <= {date_sql(weeks[-1])}").selectExpr("*", f"{number} AS __week")


def inventory_snapshot(
    receipts: DataFrame,
    weeks: Sequence[dt.date],
    lookups: Sequence[Lookup] = (),
    by: Sequence[tuple[str, str]] = (("product_id", "fact.product_id"), ("store_id", "fact.store_id")),
    sold: DataFrame | None = None,
) -> DataFrame:
    """Units on hand and newest receipt for each week and group: all receipts to date less all sales to date.

    ``receipts`` has ``receipt_date``, ``units`` and what ``by`` and ``lookups`` refer to; ``sold``
    has ``date_key``, ``units`` and the group's columns. Groups that sold no less than they received
    hold nothing and are left out. Each receipt and each sale is put into the first week on or
    after its day and summed once; a running sum over the weeks in which something moved gives all
    weeks, and a level stands until the next of them. What is shuffled is a row per group and week
    with a movement, however many weeks are asked for.
    """
    weeks = sorted(set(weeks))
    names = [name for name, _ in by]
    moved = [Partial("units", F.expr("sum(CAST(fact.units AS BIGINT))"), "sum"), Partial("newest", F.expr("max(fact.receipt_date)"), "max")]
    moves = aggregate_by_attributes(_bucketed(receipts, "receipt_date", weeks), lookups, [*by, ("__week", "fact.__week")], moved)
    if sold is not None:
        gone = _bucketed(sold, "date_key", weeks).selectExpr(
            *names, "__week", "-CAST(units AS BIGINT) AS units", "CAST(NULL AS DATE) AS newest"
        )
        both = moves.select(*names, "__week", "units", "newest").unionByName(gone)
        moves = both.groupBy(*names, "__week").agg(F.sum("units").alias("units"), F.max("newest").alias("newest"))
    if len(weeks) > 1:
        # A group has one row a week at most.
        group = Window.partitionBy(*names).orderBy("__week")
        so_far = group.rowsBetween(Window.unboundedPreceding, 0)
        moves = moves.select(
            *names,
            "__week",
            F.sum("units").over(so_far).alias("units"),
            F.max("newest").over(so_far).alias("newest"),
            F.lead("__week", 1, len(weeks)).over(group).alias("__next"),
        )
    else:
        moves = moves.withColumn("__next", F.lit(1))
    held = moves.filter("units > 0 AND newest IS NOT NULL")
    listed = ", ".join(map(date_sql, weeks))
    return held.selectExpr(
        *names,
        f"explode(slice(array({listed}), __week + 1, __next - __week)) AS week_ending_date",
        "units AS on_hand_units",
        "newest AS last_receipt_date",
    )


def valued_snapshot(snapshot: DataFrame, products: DataFrame) -> DataFrame:
    """A snapshot with cost, age, band and expected markdown, from the products' unit cost."""
    cost = f"CAST(on_hand_units * unit_cost AS {TOTAL})"
    aged = f"days_on_hand > {AGE_BOUNDS[-1]}"
    return (
        snapshot.join(unique_by(products.select("product_id", "unit_cost"), "product_id"), "product_id", "left")
        .selectExpr(
            *snapshot.columns, f"{cost} AS on_hand_cost", "datediff(week_ending_date, last_receipt_date) AS days_on_hand"
        )
        .selectExpr(
            "*",
            f"{band_sql('days_on_hand', AGE_BOUNDS, AGE_LABELS)} AS aging_bucket",
            f"{aged} AS is_aged",
            # Markdown expected on aged and on other stock.
            f"CAST(round(on_hand_cost * if({aged}, 0.45BD, 0.05BD), 2) AS {TOTAL}) AS markdown_liability_amt",
        )
    )
