"""Forecast tables from the amounts expected at quarter-end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from cashtide.functions.amounts import TOTAL, portion_sql
from cashtide.functions.dates import date_sql

# Drivers of a forecast.
BASELINE = "BASELINE"
DRIVERS = (BASELINE, "INVENTORY_TRAP", "COLLECTIONS_SLOWDOWN", "AP_ACCELERATION")


def forecast_rows(amounts: DataFrame, quarter_end: dt.date, horizon: dt.date, start_pct: int = 94) -> DataFrame:
    """Weekly path of each run and driver to its quarter-end amounts, plus the quarter-end itself.

    ``amounts`` has ``forecast_run_date``, ``driver``, ``planned_amt`` and ``projected_amt``. Weeks
    are the Saturdays after the run up to ``horizon``. In week ``i`` of ``n`` the baseline stands at
    ``start_pct`` percent plus ``i/n`` of the rest, a driver's plan at its full amount and its
    projection at ``i/n``. ``historic_path`` learns the way there from past quarters instead.
    """
    end, saturday = date_sql(quarter_end), "next_day(forecast_run_date, 'SAT')"
    # Week 0 stands for the quarter-end. One that falls on a Saturday is not listed twice.
    weekly = (
        f"filter(transform(if(n > 0, sequence(1, n), CAST(array() AS ARRAY<INT>)), "
        f"i -> named_struct('week', date_add({saturday}, 7 * (i - 1)), 'i', i)), w -> w.week <> {end})"
    )
    spread = amounts.selectExpr(
        "*", f"CAST(greatest(0, (datediff({date_sql(horizon)}, {saturday}) + 7) div 7) AS INT) AS n"
    ).selectExpr("*", f"inline(concat({weekly}, array(named_struct('week', {end}, 'i', 0))))")
    ramp = f"{start_pct} * n + {100 - start_pct} * i", "100 * n"
    return spread.selectExpr(
        "forecast_run_date",
        "week AS forecast_week_ending",
        "driver",
        f"CAST(CASE WHEN i = 0 OR driver <> '{BASELINE}' THEN planned_amt "
        f"ELSE {portion_sql('planned_amt', *ramp)} END AS {TOTAL}) AS planned_cash_amt",
        f"CAST(CASE WHEN i = 0 THEN projected_amt WHEN driver = '{BASELINE}' "
        f"THEN {portion_sql('projected_amt', *ramp)} "
        f"ELSE {portion_sql('projected_amt', 'i', 'n')} END AS {TOTAL}) AS projected_cash_amt",
    ).selectExpr("*", f"CAST(projected_cash_amt - planned_cash_amt AS {TOTAL}) AS variance_amt")
