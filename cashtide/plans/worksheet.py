"""The worksheet: one function per question, each a lazy DataFrame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, total, total_sql
from cashtide.functions.dates import date_sql
from cashtide.operators.star import Lookup, Partial, aggregate_by_attributes, at_latest, sums


def plan_vs_projected(forecast: DataFrame, quarter_end: dt.date) -> DataFrame:
    """Plan, projection and variance at quarter-end, by run, in whole units of money."""
    names = {"planned_cash_amt": "plan_cash", "projected_cash_amt": "projected_cash", "variance_amt": "variance"}
    return (
        forecast.filter(f"forecast_week_ending = {date_sql(quarter_end)}")
        .groupBy("forecast_run_date")
        .agg(*(F.expr(f"CAST(round({total_sql(c)}) AS BIGINT) AS {name}") for c, name in names.items()))
        .orderBy("forecast_run_date")
    )


def driver_variance(forecast: DataFrame, run: dt.date, quarter_end: dt.date) -> DataFrame:
    """One run's variance at quarter-end, by driver."""
    current = f"forecast_run_date = {date_sql(run)} AND forecast_week_ending = {date_sql(quarter_end)}"
    return forecast.filter(current).groupBy("driver").agg(total("variance_amt").alias("variance")).orderBy("variance")


def aged_inventory(inventory: DataFrame, products: DataFrame, latest: dt.date | None = None) -> DataFrame:
    """Cost and expected markdown of aged stock at the newest snapshot, by department and category."""
    grouped = aggregate_by_attributes(
        at_latest(inventory, "week_ending_date", latest).filter("is_aged"),
        [Lookup("product", products, "product_id", "product_id")],
        [("department", "product.department"), ("category", "product.category")],
        sums(aged_on_hand_cost="on_hand_cost", markdown_liability="markdown_liability_amt"),
        how="inner",
    )
    money = (f"CAST({c} AS {TOTAL}) AS {c}" for c in ("aged_on_hand_cost", "markdown_liability"))
    return grouped.selectExpr("department", "category", *money).orderBy(F.desc("aged_on_hand_cost"))


def po_by_status(purchase_orders: DataFrame) -> DataFrame:
    """Lines and committed cost, by status."""
    grouped = purchase_orders.groupBy("status").agg(
        F.expr("count(1) AS po_lines"), total("committed_cost").alias("committed_cost")
    )
    return grouped.orderBy(F.desc("committed_cost"))


def collections_by_channel(receivables: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Cash at risk, invoices and recent flips, by channel; with ``customers`` summed by customer before the lookup."""
    lookups = [Lookup("customer", customers, "customer_id", "customer_id")] if customers is not None else []
    grouped = aggregate_by_attributes(
        receivables.filter("cash_impact_vs_plan_amt > 0"),
        lookups,
        [("channel", "customer.channel" if lookups else "fact.channel")],
        [
            *sums(collections_at_risk="cash_impact_vs_plan_amt"),
            Partial("invoices", F.expr("count(1)"), "sum"),
            Partial("flipped_last_2wk", F.expr("count_if(fact.flipped_last_2wk)"), "sum"),
        ],
    )
    return grouped.selectExpr(
        "channel", f"CAST(collections_at_risk AS {TOTAL}) AS collections_at_risk", "invoices", "flipped_last_2wk"
    ).orderBy(F.desc("collections_at_risk"))


def disputes(receivables: DataFrame, customers: DataFrame) -> DataFrame:
    """Disputed amount by customer and reason, and whether any of it flipped recently."""
    grouped = aggregate_by_attributes(
        receivables.filter("dispute_flag"),
        [Lookup("customer", customers, "customer_id", "customer_id")],
        [("customer_name", "customer.customer_name"), ("dispute_reason", "fact.dispute_reason")],
        [
            *sums(disputed_amount="amount"),
            Partial("flipped_last_2wk", F.expr("max(fact.flipped_last_2wk)"), "max"),
        ],
        how="inner",
    )
    return grouped.selectExpr(
        "customer_name", "dispute_reason", f"CAST(disputed_amount AS {TOTAL}) AS disputed_amount", "flipped_last_2wk"
    ).orderBy(F.desc("disputed_amount"))


def ap_components(payables: DataFrame) -> DataFrame:
    """Payments and extra cash out by category, and what it is made of.

    The cost of paying early is not stored: it is the impact less the three stored parts.
    """
    grouped = payables.groupBy("payment_category").agg(
        F.expr("count(1) AS payments"),
        total("cash_impact_vs_plan_amt").alias("cash_out_vs_plan"),
        total("early_pay_discount_lost_amt").alias("early_pay_discount_lost"),
        total("surcharge_amt").alias("tariff_surcharge"),
        total("expedite_freight_amt").alias("expedited_freight"),
    )
    stored = "early_pay_discount_lost - tariff_surcharge - expedited_freight"
    return grouped.selectExpr("*", f"CAST(cash_out_vs_plan - {stored} AS {TOTAL}) AS early_payment").orderBy(
        F.desc("cash_out_vs_plan")
    )
