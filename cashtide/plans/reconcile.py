"""Checks that every number can be reached in two ways."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, total, total_or_zero
from cashtide.functions.dates import date_sql
from cashtide.operators.projection import BASELINE, DRIVERS
from cashtide.operators.star import at_latest, side_by_side
from cashtide.plans.kpis import deterioration
from cashtide.sources.tables import stacked


def quarter_end_totals(forecast: DataFrame, run: dt.date, prior_run: dt.date, quarter_end: dt.date) -> DataFrame:
    """Plan, projection, prior projection and each driver's variance at quarter-end, in one row."""
    current, prior = (f"forecast_run_date = {date_sql(d)}" for d in (run, prior_run))
    return forecast.filter(f"forecast_week_ending = {date_sql(quarter_end)}").agg(
        total("planned_cash_amt", current).alias("plan"),
        total("projected_cash_amt", current).alias("projected"),
        total("projected_cash_amt", prior).alias("prior_projected"),
        *(
            total_or_zero("variance_amt", f"{current} AND driver = '{driver}'").alias(driver)
            for driver in DRIVERS
            if driver != BASELINE
        ),
    )


def reconcile(
    inventory: DataFrame,
    receivables: DataFrame,
    payables: DataFrame,
    ledger: DataFrame | None,
    forecast: DataFrame,
    run: dt.date,
    prior_run: dt.date,
    quarter_end: dt.date,
    latest: dt.date | None = None,
    targets: Mapping[str, Decimal] | None = None,
    tolerance: Decimal | int = 0,
    apart: DataFrame | None = None,
) -> DataFrame:
    """``(check, actual, expected, diff, ok)``: facts against the forecast, or against given targets.

    ``receivables`` and ``payables`` hold what the forecast counts. Each fact is read once. Without
    a ledger the plan needs a target. ``apart`` is one row of sums taken without the forecast:
    ``disputed_apart``, ``slipped_apart``, and ``prior_gap``, the drivers' total at the prior run;
    without it the checks that need them compare the forecast with targets, or with NULL.
    """
    impact = "cash_impact_vs_plan_amt"
    facts = [
        at_latest(inventory, "week_ending_date", latest).agg(total_or_zero("on_hand_cost", "is_aged").alias("aged")),
        receivables.agg(
            total_or_zero(impact, "status = 'DISPUTED'").alias("disputed"),
            total_or_zero(impact, "status = 'SLIPPED'").alias("slipped"),
        ),
        payables.agg(total_or_zero(impact, "payment_category = 'ACCELERATED'").alias("accelerated")),
        quarter_end_totals(forecast, run, prior_run, quarter_end),
        deterioration(forecast, quarter_end)
        .filter(f"current_run_date = {date_sql(run)}")
        .agg(F.expr("max(deterioration_2wk) AS moved")),
    ]
    balance = f"CAST(NULL AS {TOTAL})"
    if ledger is not None:
        balance = "balance"
        facts.append(
            ledger.filter(f"ledger_date <= {date_sql(run)}").agg(
                F.expr(f"CAST(max_by(running_cash_balance, ledger_date) AS {TOTAL}) AS balance")
            )
        )
    names = ("disputed_apart", "slipped_apart", "prior_gap")
    if apart is not None:
        facts.append(apart.selectExpr(*(f"CAST({n} AS {TOTAL}) AS {n}" for n in names)))
    disputed, slipped, before = names if apart is not None else [f"CAST(NULL AS {TOTAL})"] * 3
    gap = "(aged + disputed + slipped + accelerated)"
    checks = {
        "aged_inventory": ("aged", "-INVENTORY_TRAP"),
        "disputed_receivables": ("disputed", disputed),
        "slipped_receivables": ("slipped", slipped),
        "collections_total": ("disputed + slipped", "-COLLECTIONS_SLOWDOWN"),
        "accelerated_payments": ("accelerated", "-AP_ACCELERATION"),
        "drivers_total": (gap, "plan - projected"),
        "plan_at_quarter_end": ("plan", balance),
        "projected_at_quarter_end": ("projected", f"plan - {gap}"),
        "prior_projected_at_quarter_end": ("prior_projected", f"plan - {before}"),
        "deterioration": ("-moved", f"{gap} - {before}"),
    }
    unknown = set(targets or {}) - set(checks)
    if unknown:
        raise KeyError(f"no such check: {sorted(unknown)}")
    given = {name: str(Decimal(value)) for name, value in (targets or {}).items()}
    entries = ", ".join(
        f"named_struct('check', '{name}', 'actual', CAST({actual} AS {TOTAL}), "
        f"'expected', CAST({given.get(name, expected)} AS {TOTAL}))"
        for name, (actual, expected) in checks.items()
    )
    return _judged(side_by_side(facts).selectExpr(f"inline(array({entries}))"), tolerance)


def same_result(name: str, one: DataFrame, other: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(check, actual, expected, diff, ok)``: how many groups differ between two results, 0 expected.

    Both are stacked with opposite signs and added up; a group missing on one side stands for 0.
    """
    signed = stacked(
        df.selectExpr(*keys, f"CAST({sign}coalesce({value}, 0) AS {TOTAL}) AS v")
        for df, sign in ((one, ""), (other, "-"))
    )
    differing = signed.groupBy(*keys).agg(F.expr("sum(v) AS v")).agg(F.expr(f"CAST(count_if(v <> 0) AS {TOTAL}) AS actual"))
    return _judged(differing.selectExpr(f"'{name}' AS check", "actual", f"CAST(0 AS {TOTAL}) AS expected"), 0)


def _judged(checks: DataFrame, tolerance: Decimal | int) -> DataFrame:
    return checks.selectExpr(
        "*",
        f"CAST(actual - expected AS {TOTAL}) AS diff",
        f"coalesce(abs(actual - expected) <= CAST({tolerance} AS {TOTAL}), false) AS ok",
    )
