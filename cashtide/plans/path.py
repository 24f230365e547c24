"""The weekly path of cash to quarter-end, as past quarters went."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, portion_sql, total
from cashtide.functions.dates import date_sql

WEEKS = 13
#: Shares are whole half-millionths, so that the median of two whole millionths is whole too.
ALL = 2_000_000


def quarter_profile(daily: DataFrame, until: dt.date) -> DataFrame:
    """``(week, reached, quarters)``: how much of a quarter's change has come by the end of each week, 0 to 13.

    ``daily`` has ``day`` and ``balance``, the balance at the end of each day with a movement. Of every
    quarter that ended by ``until``, has one before it and changed the balance, the share of its change
    reached by the end of each week (7 days from its first; the last week runs to its end) is kept
    between none and ``ALL``. ``reached`` is their exact median, and never falls from one week to the
    next. Without such a quarter there are no rows.
    """
    dated = daily.filter(f"day <= {date_sql(until)}").selectExpr("*", "trunc(day, 'QUARTER') AS quarter")
    closing = dated.groupBy("quarter", F.expr(f"CAST(least({WEEKS}, datediff(day, quarter) div 7 + 1) AS INT) AS week")).agg(
        F.expr("max_by(balance, day) AS closing")
    )
    # At most 13 weeks a quarter, and one row per quarter from here on.
    quarters = closing.groupBy("quarter").agg(F.expr("sort_array(collect_list(struct(week, closing))) AS weeks"))
    whole = quarters.selectExpr("*", "element_at(weeks, -1).closing AS ending").selectExpr(
        "*", "lag(ending) OVER (ORDER BY quarter) AS opening"
    )
    whole = whole.filter(f"opening <> ending AND date_sub(add_months(quarter, 3), 1) <= {date_sql(until)}")
    by_week = whole.selectExpr(
        f"explode(sequence(0, {WEEKS})) AS week", "weeks", "ending - opening AS moved", "opening"
    ).selectExpr("week", "moved", "coalesce(try_element_at(filter(weeks, x -> x.week <= week), -1).closing, opening) - opening AS come")
    million = "CAST(CAST(abs(come) * 100 AS DECIMAL(32,0)) * 1000000 AS DECIMAL(38,0))"
    shares = by_week.selectExpr(
        "week",
        "CASE WHEN come = 0 OR (come < 0) <> (moved < 0) THEN 0L WHEN abs(come) >= abs(moved) THEN 1000000L "
        f"ELSE {million} div CAST(abs(moved) * 100 AS DECIMAL(38,0)) END AS share",
    )
    medians = shares.groupBy("week").agg(F.expr("CAST(2 * percentile(share, 0.5) AS BIGINT) AS middle"), F.count("*").alias("quarters"))
    return medians.selectExpr("week", "max(middle) OVER (ORDER BY week) AS reached", "quarters")


def historic_path(amounts: DataFrame, daily: DataFrame, runs: Sequence[dt.date], quarter_end: dt.date) -> DataFrame:
    """Plan and projection of all cash per run on each Saturday up to the quarter-end, and at the quarter-end.

    ``amounts`` has ``forecast_run_date``, ``driver``, ``planned_amt`` and ``projected_amt`` at
    quarter-end, ``daily`` the balance per day. A path starts at the balance of the run's day
    (``opening_balance``; none yet: 0) and covers what is left to the quarter-end in the shares that
    past quarters, ended by the first run, had reached by the last full week of the quarter, less what
    they had by the run's. Before the quarter begins it stays where it is. Where no quarter has ended
    yet, or nothing is left by that profile, the path is straight (``from_history`` is false).
    """
    end, start = date_sql(quarter_end), f"trunc({date_sql(quarter_end)}, 'QUARTER')"
    runs = sorted(runs)
    ends = amounts.groupBy("forecast_run_date").agg(total("planned_amt").alias("planned"), total("projected_amt").alias("projected"))
    latest = daily.agg(*(F.expr(f"max_by(balance, day) FILTER (WHERE day <= {date_sql(run)}) AS v{n}") for n, run in enumerate(runs)))
    openings = latest.selectExpr(
        "inline(array("
        + ", ".join(f"named_struct('forecast_run_date', {date_sql(run)}, 'opening_balance', coalesce(CAST(v{n} AS {TOTAL}), 0BD))" for n, run in enumerate(runs))
        + "))"
    )
    saturday = "next_day(forecast_run_date, 'SAT')"
    days = f"filter(sequence({saturday}, greatest({saturday}, {end}), INTERVAL 7 DAYS), d -> d < {end})"

    def weeks_by(day: str) -> str:
        return f"CAST(greatest(0, least({WEEKS}, (datediff({day}, {start}) + 1) div 7)) AS INT)"

    dated = ends.join(openings, "forecast_run_date").selectExpr("*", f"explode(concat({days}, array({end}))) AS forecast_week_ending")
    dated = dated.selectExpr("*", f"{weeks_by('forecast_run_date')} AS week0", f"{weeks_by('forecast_week_ending')} AS week")
    profile = quarter_profile(daily, runs[0]).select("week", "reached")
    at_run = profile.select(F.col("week").alias("week0"), F.col("reached").alias("reached0"))
    known = f"coalesce(reached0 < {ALL} AND reached IS NOT NULL, false)"
    shared = dated.join(at_run, "week0", "left").join(profile, "week", "left").selectExpr("*", f"{known} AS from_history")
    shared = shared.selectExpr(
        "*",
        "if(from_history, reached - reached0, datediff(forecast_week_ending, forecast_run_date)) AS part",
        f"if(from_history, {ALL} - reached0, datediff({end}, forecast_run_date)) AS whole",
    )

    def level(amount: str) -> str:
        left = portion_sql(f"CAST({amount} - opening_balance AS {TOTAL})", "part", "whole")
        return f"CAST(if(forecast_week_ending = {end}, {amount}, opening_balance + {left}) AS {TOTAL})"

    return shared.selectExpr(
        "forecast_run_date",
        "forecast_week_ending",
        "from_history",
        f"CAST(opening_balance AS {TOTAL}) AS opening_balance",
        f"{level('planned')} AS planned_cash_amt",
        f"{level('projected')} AS projected_cash_amt",
    ).selectExpr("*", f"CAST(projected_cash_amt - planned_cash_amt AS {TOTAL}) AS variance_amt")
