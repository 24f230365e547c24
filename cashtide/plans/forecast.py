"""Cash balance forecasts: a fitted trend with prediction intervals, in built-in aggregates only."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, total
from cashtide.functions.dates import date_sql, week_ending
from cashtide.operators.ordered import daily_balance

ALL = "ALL"


def balance_series(ledger: DataFrame, by_category: bool) -> DataFrame:
    """``(segment, day, balance)``: end-of-day balance of all cash, or of each category's flows."""
    segment = "cash_category" if by_category else f"'{ALL}'"
    daily = ledger.groupBy(F.expr(f"{segment} AS segment"), F.expr("ledger_date AS day")).agg(
        F.expr("sum(net_cash_amt) AS net")
    )
    return daily_balance(daily, "day", "net", by=["segment"]).drop("net")


_WHOLE = "DECIMAL(38,0)"
#: Sums behind a line, by name: the aggregate and the type it comes in.
_SUMS = {
    "n": ("count(1)", "BIGINT"),
    "base": ("min(first_level)", "DECIMAL(20,0)"),
    "sx": ("sum(x)", "BIGINT"),
    "sxx": ("sum(x * x)", "BIGINT"),
    "sy": (f"sum(CAST(y AS {_WHOLE}))", _WHOLE),
    "sxy": (f"sum(CAST(x * y AS {_WHOLE}))", _WHOLE),
    "syy": (f"sum(CAST(y * y AS {_WHOLE}))", _WHOLE),
}


def _points(series: DataFrame, first_day: dt.date) -> DataFrame:
    """Days since ``first_day`` and balances to the unit, less the segment's first one."""
    points = series.selectExpr(
        "segment",
        "day",
        "balance",
        f"CAST(datediff(day, {date_sql(first_day)}) AS BIGINT) AS x",
        "CAST(round(balance, 0) AS DECIMAL(20,0)) AS level",
    ).selectExpr("*", "first(level) OVER (PARTITION BY segment ORDER BY x) AS first_level")
    return points.selectExpr("segment", "day", "balance", "x", "first_level", "CAST(level - first_level AS DECIMAL(18,0)) AS y")


def _fitted(summed: DataFrame, *others: str) -> DataFrame:
    """Slope, intercept and spread from the sums of a line, on each row that carries them."""
    return (
        summed.filter("n > 2")
        .selectExpr(
            "*",
            "CAST(n * sxx - sx * sx AS DOUBLE) AS dxx",
            f"CAST(CAST(n * sxy AS {_WHOLE}) - CAST(sx * sy AS {_WHOLE}) AS DOUBLE) AS dxy",
            f"CAST(CAST(n * syy AS {_WHOLE}) - CAST(sy * sy AS {_WHOLE}) AS DOUBLE) AS dyy",
        )
        .filter("dxx > 0")
        .selectExpr(
            "segment",
            "n",
            "sx",
            "dxx",
            "dxy / dxx AS slope",
            "CAST(base AS DOUBLE) + (CAST(sy AS DOUBLE) - (dxy / dxx) * sx) / n AS intercept",
            "sqrt(greatest(0D, dyy - dxy * dxy / dxx) / n / (n - 2)) AS spread",
            *others,
        )
    )


def trend(series: DataFrame, first_day: dt.date) -> DataFrame:
    """Least-squares line through each segment's daily balances, days counted from ``first_day``.

    The sums are taken in whole numbers (balances to the unit, less the segment's first one), so
    they do not depend on the order of rows, and squares of large balances stay in range.
    """
    sums = (F.expr(f"CAST({how} AS {kind})").alias(name) for name, (how, kind) in _SUMS.items())
    return _fitted(_points(series, first_day).groupBy("segment").agg(*sums))


def seasonal_trend(series: DataFrame, first_day: dt.date) -> DataFrame:
    """``trend`` with ``effects``, the mean distance from it by day of week, and the spread that is left after them.

    Each day carries its segment's sums, from a window over a frame of days, so the line meets its
    points without a join. Distances are taken in whole units, so that their sums do not depend
    on the order of rows.
    """
    sums = (f"CAST({how} OVER (PARTITION BY segment) AS {kind}) AS {name}" for name, (how, kind) in _SUMS.items())
    away = "CAST(round(CAST(balance AS DOUBLE) - (intercept + slope * x), 0) AS DECIMAL(18,0)) AS r"
    days = _fitted(_points(series, first_day).selectExpr("*", *sums), "day", "balance", "x")
    days = days.selectExpr("*", "weekday(day) AS d", away)
    line = ("n", "sx", "dxx", "slope", "intercept")
    by_day = days.groupBy("segment", "d").agg(
        F.expr("count(1) AS m"), F.expr(f"CAST(sum(CAST(r AS {_WHOLE})) AS {_WHOLE}) AS s"),
        F.expr(f"CAST(sum(CAST(r * r AS {_WHOLE})) AS {_WHOLE}) AS ss"),
        # All rows of a segment carry the same line.
        *(F.min(name).alias(name) for name in line),
    )
    found = by_day.groupBy("segment").agg(
        F.expr("map_from_entries(array_sort(collect_list(struct(d, CAST(s AS DOUBLE) / m)))) AS effects"),
        F.expr(f"CAST(sum(ss) AS {_WHOLE}) AS rr"),
        F.expr("array_sort(collect_list(struct(d, CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / m AS part))) AS parts"),
        F.expr("count(1) AS days"),
        *(F.min(name).alias(name) for name in line),
    )
    explained = "aggregate(parts, 0D, (a, p) -> a + p.part)"
    left = f"sqrt(greatest(0D, CAST(rr AS DOUBLE) - {explained}) / greatest(1, n - 1 - days))"
    return found.selectExpr("segment", *line, f"{left} AS spread", "effects")


def predict_cash_flow(
    ledger: DataFrame,
    as_of: dt.date,
    horizon: Sequence[dt.date],
    segment: str | None = None,
    by_category: bool = False,
    level: float = 0.95,
    history_days: int | None = None,
    seasonal: bool = False,
) -> DataFrame:
    """Projected balance on each day of ``horizon`` with a prediction interval, per segment.

    The trend is fitted to all days up to ``as_of``, or to the last ``history_days`` of them where
    the caller names a window. A segment is a cash category, or everything. With ``seasonal`` each day
    of the week adds its mean distance from the trend, and the interval is that of what remains.
    """
    first_day = as_of - dt.timedelta(days=history_days - 1) if history_days else as_of
    series = balance_series(ledger.filter(f"ledger_date <= {date_sql(as_of)}"), by_category or segment is not None)
    if segment is not None:
        series = series.filter(F.col("segment") == segment)
    points = ", ".join(
        f"named_struct('d', {date_sql(d)}, 'x', {float((d - first_day).days)}D, 'wd', {d.weekday()})" for d in horizon
    )
    if history_days:
        series = series.filter(f"day >= {date_sql(first_day)}")
    if seasonal:
        line = seasonal_trend(series, first_day)
    else:
        line = trend(series, first_day).selectExpr("*", "CAST(map() AS MAP<INT, DOUBLE>) AS effects")
    z = NormalDist().inv_cdf(0.5 + level / 2)
    off_centre = "(x - CAST(sx AS DOUBLE) / n)"
    return (
        line.selectExpr("*", f"inline(array({points}))")
        .selectExpr(
            "segment",
            "d AS forecast_date",
            "intercept + slope * x + coalesce(element_at(effects, wd), 0D) AS middle",
            f"{z!r}D * spread * sqrt(1 + 1D / n + {off_centre} * {off_centre} / (dxx / n)) AS width",
        )
        .selectExpr(
            "segment",
            "forecast_date",
            f"CAST(round(middle, 0) AS {TOTAL}) AS projected_balance",
            f"CAST(round(middle - width, 0) AS {TOTAL}) AS lower_bound",
            f"CAST(round(middle + width, 0) AS {TOTAL}) AS upper_bound",
        )
    )


def backtested_forecast(
    ledger: DataFrame, as_of: dt.date, ahead: Sequence[int], by_category: bool = False, level: float = 0.95, least: int = 60
) -> DataFrame:
    """Projected balance so many days ahead, with an interval as wide as past forecasts were wrong.

    Every day with at least ``least`` days of history is an origin: the line fitted to the days up to it
    is continued by each number of days in ``ahead`` and held against the balance that came. The
    interval is the projection plus and minus the ``level`` quantile of those errors, whatever
    their distribution; balances of neighbouring days depend on one another, so the textbook
    interval, which takes them for independent, is too narrow. ``coverage`` is the share of origins
    for which the textbook interval held the balance. ``origins`` is their number; without any, bounds are NULL.

    Lines come from running sums over a frame of days and balances to come from a frame that reaches
    ahead, so days are sorted once, nothing is joined, and a longer list of horizons costs columns, not passes.
    """
    series = balance_series(ledger.filter(f"ledger_date <= {date_sql(as_of)}"), by_category)
    upto = "OVER (PARTITION BY segment ORDER BY x ROWS UNBOUNDED PRECEDING)"
    sums = (f"CAST({how} {upto} AS {kind}) AS {name}" for name, (how, kind) in _SUMS.items())
    days = _fitted(_points(series, as_of).selectExpr("*", *sums), "x", "balance")
    days = days.selectExpr("*", "max(x) OVER (PARTITION BY segment) AS last_x", *(
        f"last(balance) OVER (PARTITION BY segment ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND {int(h)} FOLLOWING) AS came{h}"
        for h in ahead
    ))
    z = NormalDist().inv_cdf(0.5 + level / 2)
    off_centre = "({x} - CAST(sx AS DOUBLE) / n)"
    wide = f"{z!r}D * spread * sqrt(1 + 1D / n + {off_centre} * {off_centre} / (dxx / n))"
    missed, results = [], [F.expr("max_by(struct(n, sx, dxx, slope, intercept, spread), x) AS line")]
    for h in ahead:
        known = f"n >= {int(least)} AND x + {int(h)} <= last_x"
        away = f"(CAST(came{h} AS DOUBLE) - (intercept + slope * (x + {int(h)})))"
        inside = f"abs({away}) <= {wide.format(x=f'(x + {int(h)})')}"
        missed += [f"if({known}, CAST(abs(round({away}, 0)) AS DECIMAL(20,0)), NULL) AS away{h}", f"if({known} AND {inside}, 1, 0) AS held{h}"]
        results += [
            F.expr(f"count(away{h}) AS origins{h}"),
            F.expr(f"percentile_disc({float(level)}D) WITHIN GROUP (ORDER BY away{h}) AS width{h}"),
            F.expr(f"sum(held{h}) AS held{h}"),
        ]
    found = days.selectExpr("*", *missed).groupBy("segment").agg(*results)
    points = ", ".join(
        f"named_struct('horizon_days', {int(h)}, 'forecast_date', {date_sql(as_of + dt.timedelta(days=int(h)))}, "
        f"'middle', line.intercept + line.slope * {int(h)}, 'width', width{h}, 'origins', origins{h}, 'held', held{h})"
        for h in ahead
    )
    middle, width = "CAST(round(middle, 0) AS DECIMAL(26,0))", "CAST(width AS DECIMAL(26,0))"
    return found.selectExpr("segment", f"inline(array({points}))").selectExpr(
        "segment",
        "horizon_days",
        "forecast_date",
        f"CAST({middle} AS {TOTAL}) AS projected_balance",
        f"CAST({middle} - {width} AS {TOTAL}) AS lower_bound",
        f"CAST({middle} + {width} AS {TOTAL}) AS upper_bound",
        "origins",
        "round(try_divide(CAST(held AS DOUBLE), CAST(origins AS DOUBLE)), 4) AS coverage",
    )


def rolling_weeks(ledger: DataFrame, as_of: dt.date, weeks: int = 13, history_days: int | None = None) -> DataFrame:
    """The last ``weeks`` weeks as they were and the next ones as forecast, one row a week."""
    saturday = as_of + dt.timedelta(days=(5 - as_of.weekday()) % 7)
    ahead = [saturday + dt.timedelta(weeks=n) for n in range(1, weeks + 1)]
    first = saturday - dt.timedelta(weeks=weeks)
    seen = ledger.filter(f"ledger_date <= {date_sql(as_of)} AND ledger_date > {date_sql(first)}")
    actual = seen.groupBy(week_ending("ledger_date").alias("week_ending_date")).agg(
        F.expr("'ACTUAL' AS kind"),
        total("cash_in_amt").alias("cash_in"),
        total("cash_out_amt").alias("cash_out"),
        F.expr(f"CAST(max_by(running_cash_balance, ledger_date) AS {TOTAL}) AS closing_balance"),
    )
    projected = predict_cash_flow(ledger, as_of, ahead, history_days=history_days).selectExpr(
        "forecast_date AS week_ending_date",
        "'FORECAST' AS kind",
        "projected_balance AS closing_balance",
        "lower_bound",
        "upper_bound",
    )
    return actual.unionByName(projected, allowMissingColumns=True).orderBy("week_ending_date")


def register_forecast(predictions: DataFrame, name: str = "predict_cash_flow") -> None:
    """Make predictions callable by segment from SQL: ``SELECT * FROM predict_cash_flow('ALL')``."""
    spark = predictions.sparkSession
    predictions.createOrReplaceTempView(f"{name}_rows")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(wanted STRING) "
        "RETURNS TABLE (forecast_date DATE, projected_balance DECIMAL(28,2), "
        "lower_bound DECIMAL(28,2), upper_bound DECIMAL(28,2)) "
        f"RETURN SELECT forecast_date, projected_balance, lower_bound, upper_bound FROM {name}_rows "
        f"WHERE segment = {name}.wanted"
    )
