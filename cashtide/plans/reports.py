"""Report datasets."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import (
    AGE_LABELS,
    PAST_DUE_BOUNDS,
    PAST_DUE_LABELS,
    TOTAL,
    band_sql,
    ratio_sql,
    total,
    total_or_zero,
)
from cashtide.functions.dates import date_sql, open_as_of, trailing, week_ending
from cashtide.operators.projection import BASELINE, DRIVERS
from cashtide.operators.star import Lookup, Partial, aggregate_by_attributes, at_latest, sums, unique_by


def waterfall(forecast: DataFrame, run: dt.date, quarter_end: dt.date) -> DataFrame:
    """From plan to projection at quarter-end: plan, each driver (worst first), the rest, projection."""
    named = [d for d in DRIVERS if d != BASELINE]
    current = f"forecast_run_date = {date_sql(run)} AND forecast_week_ending = {date_sql(quarter_end)}"
    totals = forecast.filter(current).agg(
        total_or_zero("planned_cash_amt").alias("plan"),
        total_or_zero("projected_cash_amt").alias("projected"),
        *(total_or_zero("variance_amt", f"driver = '{d}'").alias(d) for d in named),
    )
    rest = "projected - plan - " + " - ".join(named)
    bars = [(0, "plan", "PLAN"), *((1, d, d) for d in named), (2, rest, "OTHER"), (3, "projected", "PROJECTED")]
    entries = ", ".join(
        f"named_struct('section', {section}, 'amount', CAST({amount} AS {TOTAL}), 'item', '{item}')"
        for section, amount, item in bars
    )
    return (
        totals.selectExpr(f"posexplode(array_sort(array({entries}))) AS (step, bar)")
        .selectExpr(
            "step",
            "bar.item AS item",
            "bar.amount AS amount",
            f"CAST(sum(if(bar.section = 3, 0, bar.amount)) OVER (ORDER BY step) AS {TOTAL}) AS running",
        )
        .orderBy("step")
    )


def ar_aging(receivables: DataFrame, as_of: dt.date, customers: DataFrame | None = None) -> DataFrame:
    """Open invoices by channel and days past due; with ``customers`` summed by customer before the lookup."""
    past_due = band_sql(f"datediff({date_sql(as_of)}, due_date)", PAST_DUE_BOUNDS, PAST_DUE_LABELS)
    lookups = [Lookup("customer", customers, "customer_id", "customer_id")] if customers is not None else []
    grouped = aggregate_by_attributes(
        receivables.filter(open_as_of("invoice_date", "paid_date", as_of)).withColumn("past_due_bucket", F.expr(past_due)),
        lookups,
        [("channel", "customer.channel" if lookups else "fact.channel"), ("past_due_bucket", "fact.past_due_bucket")],
        [*sums(open_amount="amount"), Partial("invoices", F.expr("count(1)"), "sum")],
    )
    return grouped.selectExpr("channel", "past_due_bucket", "invoices", f"CAST(open_amount AS {TOTAL}) AS open_amount")


def ap_schedule(payables: DataFrame, as_of: dt.date) -> DataFrame:
    """Payments due after ``as_of`` by week, and how much of each week was or will be paid early."""
    return (
        payables.filter(f"scheduled_pay_date > {date_sql(as_of)}")
        .groupBy(week_ending("scheduled_pay_date").alias("pay_week"))
        .agg(
            F.expr("count(1) AS payments"),
            total("invoice_amt").alias("scheduled_amt"),
            total_or_zero("invoice_amt", "payment_category = 'ACCELERATED'").alias("accelerated_amt"),
            total_or_zero("invoice_amt", f"actual_pay_date <= {date_sql(as_of)}").alias("already_paid_amt"),
        )
        .orderBy("pay_week")
    )


def inventory_aging(
    inventory: DataFrame, products: DataFrame, stores: DataFrame, latest: dt.date | None = None
) -> DataFrame:
    """Stock at cost by department, category and region, one column per age band."""
    bands = dict(zip(AGE_LABELS, ("days_0_30", "days_31_60", "days_61_90", "days_over_90"), strict=True))
    banded = aggregate_by_attributes(
        at_latest(inventory, "week_ending_date", latest),
        [Lookup("product", products, "product_id", "product_id"), Lookup("store", stores, "store_id", "store_id")],
        [("department", "product.department"), ("category", "product.category"), ("region", "store.region")],
        sums(
            **{name: f"if(fact.aging_bucket = '{label}', fact.on_hand_cost, 0)" for label, name in bands.items()},
            on_hand_cost="on_hand_cost",
        ),
    )
    money = (f"CAST({c} AS {TOTAL}) AS {c}" for c in (*bands.values(), "on_hand_cost"))
    return banded.selectExpr("department", "category", "region", *money)


def sell_through_gap(rates: DataFrame, plan: DataFrame | Decimal | float) -> DataFrame:
    """Sell-through against plan: one rate for all, or a frame ``(department, category, plan_rate)``."""
    if isinstance(plan, DataFrame):
        planned = rates.join(plan.select("department", "category", "plan_rate"), ["department", "category"], "left")
    else:
        planned = rates.withColumn("plan_rate", F.lit(float(plan)))
    return planned.selectExpr(
        "department", "category", "sell_through_rate", "plan_rate", "round(sell_through_rate - plan_rate, 3) AS gap"
    ).orderBy("gap")


def terms_variance(payables: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Terms applied and terms kept against the agreed ones, weighted by invoice, per supplier.

    Payments add up per supplier before the supplier is looked up, so a supplier with a third of
    all payments is one row in the join.
    """
    paid = payables.groupBy("supplier_id").agg(
        F.expr("count(1) AS payments"),
        total("invoice_amt").alias("invoice_amt"),
        total("invoice_amt * terms_days").alias("applied"),
        total("invoice_amt * (terms_days - days_early)").alias("kept"),
    )
    terms = unique_by(suppliers.select("supplier_id", "supplier_name", "default_terms_days"), "supplier_id")
    return (
        paid.join(terms, "supplier_id", "left")
        .selectExpr(
            "supplier_id",
            "supplier_name",
            "payments",
            "invoice_amt",
            "default_terms_days",
            f"{ratio_sql('applied', 'invoice_amt', 2)} AS applied_terms_days",
            f"{ratio_sql('kept', 'invoice_amt', 2)} AS kept_terms_days",
        )
        .selectExpr("*", "round(kept_terms_days - default_terms_days, 2) AS variance_days")
    )


def open_ar_target(
    sales: DataFrame, as_of: dt.date, dso_days: Decimal, other_ar: Decimal, floor: Decimal, days: int = 90
) -> DataFrame:
    """The open receivables that a target DSO implies, after other receivables, never under a floor."""
    sold = sales.filter(trailing("date_key", as_of, days)).agg(total("net_sales_amt").alias("net_sales"))
    implied = f"round(net_sales * CAST({dso_days} AS DECIMAL(6,2)) / CAST({days} AS DECIMAL(4,0)), 2)"
    return sold.selectExpr("*", f"CAST({implied} AS {TOTAL}) AS outstanding_target").selectExpr(
        "*",
        f"greatest(CAST({floor} AS {TOTAL}), CAST(outstanding_target - CAST({other_ar} AS {TOTAL}) AS {TOTAL})) "
        "AS open_target",
    )
