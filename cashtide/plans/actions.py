"""Levers against a shortfall. Every list is whole: sorted by effect, never cut off."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import total, total_or_zero
from cashtide.functions.dates import date_sql, trailing
from cashtide.operators.star import unique_by


def cancel_orders(
    purchase_orders: DataFrame, products: DataFrame, rates: DataFrame, as_of: dt.date, below: float
) -> DataFrame:
    """Open orders still inbound in categories that sell through less than ``below``.

    Order lines add up per product and supplier before categories are looked up.
    """
    inbound = (
        purchase_orders.filter(f"status = 'OPEN' AND expected_receipt_date > {date_sql(as_of)}")
        .groupBy("product_id", "supplier_id")
        .agg(
            F.expr("count(1) AS open_lines"),
            F.expr("CAST(sum(ordered_units) AS BIGINT) AS open_units"),
            total("committed_cost").alias("committed_cost"),
            F.expr("min(expected_receipt_date) AS next_receipt_date"),
        )
    )
    weak = rates.filter(f"sell_through_rate < {float(below)}D").select("department", "category", "sell_through_rate")
    placed = unique_by(products.select("product_id", "department", "category"), "product_id").join(weak, ["department", "category"])
    return inbound.join(placed, "product_id").orderBy(F.desc("committed_cost"), "product_id", "supplier_id")


def defer_payments(payables: DataFrame, suppliers: DataFrame, as_of: dt.date, quarter_end: dt.date) -> DataFrame:
    """Payments about to leave early: the cash kept by paying on schedule, and what of it stays past quarter-end."""
    end = date_sql(quarter_end)
    due = (
        payables.filter(f"days_early > 0 AND actual_pay_date > {date_sql(as_of)}")
        .groupBy("supplier_id")
        .agg(
            F.expr("count(1) AS payments"),
            total("invoice_amt").alias("deferrable_cash"),
            total_or_zero("invoice_amt", f"actual_pay_date <= {end} AND scheduled_pay_date > {end}").alias(
                "kept_past_quarter_end"
            ),
            total("cash_impact_vs_plan_amt").alias("avoidable_cost"),
            F.expr("min(actual_pay_date) AS next_pay_date"),
        )
    )
    names = unique_by(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    return due.join(names, "supplier_id", "left").orderBy(F.desc("deferrable_cash"), "supplier_id")


def on_time_low(paid: str, on_time: str, z: float = 1.96) -> str:
    """The lower end of the Wilson interval of a share, as SQL; NULL without any invoice.

    Few invoices make the interval wide, so a customer needs a record, not one lucky payment.
    """
    n, share = f"CAST({paid} AS DOUBLE)", f"(CAST({on_time} AS DOUBLE) / nullif({paid}, 0))"
    zz = float(z) * float(z)
    spread = f"sqrt({share} * (1D - {share}) / {n} + {zz / 4!r}D / ({n} * {n}))"
    return f"if({paid} = 0, NULL, ({share} + {zz / 2!r}D / {n} - {float(z)!r}D * {spread}) / (1D + {zz!r}D / {n}))"


def chase_collections(
    receivables: DataFrame, customers: DataFrame, as_of: dt.date, confident: float = 0.5, only_confident: bool = False
) -> DataFrame:
    """Overdue and undisputed: what each customer owes, for how long, and how surely it will be collected.

    The record of a customer is the share of its paid invoices that were paid by their due date.
    Confidence is HIGH where the lower end of that share's 95% interval is at least ``confident``,
    LOW where it is not, UNKNOWN for customers that never paid; ``reason`` says why. Debts and
    record come from one pass over the invoices.
    """
    today = date_sql(as_of)
    overdue = f"status = 'OPEN' AND NOT dispute_flag AND due_date < {today}"
    paid = f"paid_date <= {today}"
    owed = (
        receivables.groupBy("customer_id")
        .agg(
            F.expr(f"count(1) FILTER (WHERE {overdue}) AS invoices"),
            total("amount", overdue).alias("overdue_amount"),
            F.expr(f"min(due_date) FILTER (WHERE {overdue}) AS oldest_due_date"),
            F.expr(f"count(1) FILTER (WHERE {paid}) AS paid_invoices"),
            F.expr(f"count(1) FILTER (WHERE {paid} AND paid_date <= due_date) AS paid_on_time"),
        )
        .filter("invoices > 0")
        .selectExpr(
            "customer_id",
            "invoices",
            "overdue_amount",
            "oldest_due_date",
            f"datediff({today}, oldest_due_date) AS days_past_due",
            "paid_invoices",
            "paid_on_time",
            f"round({on_time_low('paid_invoices', 'paid_on_time')}, 4) AS on_time_low",
        )
        .selectExpr(
            "*",
            f"CASE WHEN on_time_low IS NULL THEN 'UNKNOWN' WHEN on_time_low >= {float(confident)}D THEN 'HIGH' ELSE 'LOW' END AS confidence",
            "if(paid_invoices = 0, 'nothing paid so far', concat(paid_on_time, ' of ', paid_invoices, ' paid on time')) AS reason",
        )
    )
    if only_confident:
        owed = owed.filter("confidence = 'HIGH'")
    names = unique_by(customers.select("customer_id", "customer_name"), "customer_id")
    return owed.join(names, "customer_id", "left").orderBy(F.desc("overdue_amount"), "customer_id")


def stock_balance(
    inventory_latest: DataFrame, sales: DataFrame, as_of: dt.date, weeks: int, target_weeks: int
) -> DataFrame:
    """Units above (or, negative, below) the target cover, per product and location."""
    held = inventory_latest.selectExpr("product_id", "store_id", "CAST(on_hand_units AS BIGINT) AS held", "0L AS sold")
    sold = sales.filter(trailing("date_key", as_of, 7 * weeks)).selectExpr(
        "product_id", "store_id", "0L AS held", "CAST(units_sold AS BIGINT) AS sold"
    )
    # Both sides come as rows of one shape, so one grouped sum replaces a full outer join.
    cover = f"(sum(sold) * {target_weeks} + {weeks - 1}) div {weeks}"
    return held.unionByName(sold).groupBy("product_id", "store_id").agg(F.expr(f"sum(held) - {cover} AS over"))


def reflow(balance: DataFrame) -> DataFrame:
    """Moves from locations with too much of a product to locations with too little.

    Per product the surpluses, biggest first, are laid end to end, and so are the deficits; where
    two pieces overlap, those units move. The ends of all pieces, in order, cut the line into
    segments, and each segment belongs to the next surplus end and the next deficit end. No pairs
    are formed. A group holds one row per location of one product.
    """
    laid = "PARTITION BY product_id, gives ORDER BY units DESC, store_id ROWS UNBOUNDED PRECEDING"
    line = "PARTITION BY product_id ORDER BY stop, gives"
    ahead = f"OVER ({line} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (
        balance.filter("over <> 0")
        .selectExpr("product_id", "store_id", "over > 0 AS gives", "abs(over) AS units")
        .selectExpr("*", f"sum(units) OVER ({laid}) AS stop")
        .selectExpr(
            "product_id",
            f"first(if(gives, store_id, NULL), true) {ahead} AS from_store_id",
            f"first(if(gives, NULL, store_id), true) {ahead} AS to_store_id",
            f"CAST(stop - lag(stop, 1, 0L) OVER ({line}) AS BIGINT) AS units",
        )
        .filter("units > 0 AND from_store_id IS NOT NULL AND to_store_id IS NOT NULL")
    )
