"""When a forecast deserves attention."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, total
from cashtide.functions.dates import date_sql


def _runs(forecast: DataFrame, quarter_end: dt.date) -> DataFrame:
    """One row per forecast run: its variance and projection at quarter-end."""
    return (
        forecast.filter(f"forecast_week_ending = {date_sql(quarter_end)}")
        .groupBy("forecast_run_date")
        .agg(total("variance_amt").alias("variance"), total("projected_cash_amt").alias("projected"))
    )


def cash_alert(
    forecast: DataFrame, quarter_end: dt.date, level: Decimal | int, velocity: Decimal | int, k: float = 2.0
) -> DataFrame:
    """One row per forecast run: how far below plan, how fast it got worse, and whether to alert.

    A run alerts when it is at least ``level`` below plan, lost at least ``velocity`` since the run
    before, and that loss lies ``k`` standard deviations below the mean of the earlier changes. The
    last condition needs two earlier changes and is waived until there are.
    """
    runs = _runs(forecast, quarter_end)
    order = "ORDER BY forecast_run_date"
    earlier = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    change = "CAST(deterioration AS DOUBLE)"
    low, fast = f"variance <= -CAST({level} AS {TOTAL})", f"coalesce(deterioration <= -CAST({velocity} AS {TOTAL}), false)"
    return (
        runs.selectExpr("*", f"CAST(projected - lag(projected) OVER ({order}) AS {TOTAL}) AS deterioration")
        .selectExpr("*", f"round(avg({change}) {earlier} - {float(k)}D * stddev_samp({change}) {earlier}, 0) AS floor_")
        .selectExpr(
            "forecast_run_date",
            "variance",
            "deterioration",
            f"CAST(floor_ AS {TOTAL}) AS control_limit",
            f"{low} AS level_breach",
            f"{fast} AS velocity_breach",
            f"{low} AND {fast} AND coalesce({change} < floor_, true) AS alert",
        )
        .orderBy("forecast_run_date")
    )


def drift_alert(
    forecast: DataFrame, quarter_end: dt.date, slack: Decimal | int, limit: Decimal | int, expected: Decimal | int = 0
) -> DataFrame:
    """One row per forecast run: how far the projection has drifted from its ``expected`` change per run.

    Two running sums, ``falling`` and ``rising``, add up by how much each change lies below and above
    what is expected, less ``slack``; they never go below zero, and start again after a run in which
    they exceed ``limit``, which is a signal. So many small losses signal that no control limit sees,
    as those losses widen it. ``falling_since`` and ``rising_since`` are the runs in which the sums
    left zero: the likely start of the drift. The first run has no change. The runs are folded in
    order in one row, which holds a few numbers per run and none of the forecast's rows.
    """
    ordered = _runs(forecast, quarter_end).agg(F.expr("sort_array(collect_list(struct(forecast_run_date AS run, projected))) AS runs"))
    changes = ordered.selectExpr(
        "transform(runs, (r, i) -> named_struct('run', r.run, 'change', "
        f"CAST(r.projected - if(i = 0, NULL, try_element_at(runs, i).projected) AS {TOTAL}))) AS changes"
    )
    before = "try_element_at(seen, -1)"

    def summed(name: str, excess: str) -> str:
        carried = f"if(coalesce({before}.{name} <= {limit}, false), {before}.{name}, 0)"
        return f"CAST(greatest(0, {carried} + coalesce({excess} - {slack}, 0)) AS {TOTAL})"

    def since(name: str, value: str) -> str:
        carried = f"if({before}.{name} <= {limit}, {before}.{name}_since, NULL)"
        return f"if({value} > 0, coalesce({carried}, now.run), NULL)"

    falling, rising = summed("falling", f"{expected} - now.change"), summed("rising", f"now.change - {expected}")
    fields = {
        "run": ("DATE", "now.run"),
        "change": (TOTAL, "now.change"),
        "falling": (TOTAL, falling),
        "rising": (TOTAL, rising),
        "falling_since": ("DATE", since("falling", falling)),
        "rising_since": ("DATE", since("rising", rising)),
    }
    kind = ", ".join(f"{name}: {type_}" for name, (type_, _) in fields.items())
    entry = ", ".join(f"'{name}', {value}" for name, (_, value) in fields.items())
    folded = f"aggregate(changes, CAST(array() AS ARRAY<STRUCT<{kind}>>), (seen, now) -> concat(seen, array(named_struct({entry}))))"
    return (
        changes.selectExpr(f"inline({folded})")
        .selectExpr(
            "run AS forecast_run_date",
            "change AS deterioration",
            "falling",
            "falling_since",
            "rising",
            "rising_since",
            f"CASE WHEN falling > {limit} THEN 'FALLING' WHEN rising > {limit} THEN 'RISING' END AS signal",
        )
        .orderBy("forecast_run_date")
    )
