"""Calendar arithmetic on DATE columns, as SQL expressions and as columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_sql(value: dt.date) -> str:
    return f"DATE'{value.isoformat()}'"


def day_sql(column: str) -> str:
    """A timestamp's calendar day."""
    return f"CAST({column} AS DATE)"


def trailing_sql(column: str, as_of: dt.date, days: int) -> str:
    first_out = as_of - dt.timedelta(days=days)
    return f"({column} > {date_sql(first_out)} AND {column} <= {date_sql(as_of)})"


def trailing(column: Column | str, as_of: dt.date, days: int) -> Column:
    """True in the ``days`` days that end with ``as_of`` (which counts; the day before the first does not).

    Both ends are literals, so the condition reaches the scan.
    """
    value = F.col(column) if isinstance(column, str) else column
    return (value > F.lit(as_of - dt.timedelta(days=days))) & (value <= F.lit(as_of))


def open_as_of(start: str, end: str, as_of: dt.date) -> Column:
    """True when something had started by ``as_of`` and had not ended yet; a NULL end is open."""
    limit = date_sql(as_of)
    return F.expr(f"{start} <= {limit} AND ({end} IS NULL OR {end} > {limit})")


def week_ending_sql(column: str) -> str:
    return f"next_day(date_sub({column}, 1), 'SAT')"


def week_ending(column: str) -> Column:
    """The Saturday that closes a day's week; a Saturday closes its own."""
    return F.expr(week_ending_sql(column))


def fiscal_quarter_sql(column: str) -> str:
    return f"concat('FY', year({column}), '-Q', quarter({column}))"


def fiscal_quarter(column: str) -> Column:
    """Label such as ``FY2026-Q4``; fiscal years are calendar years."""
    return F.expr(fiscal_quarter_sql(column))


def calendar(bounds: DataFrame) -> DataFrame:
    """The calendar dimension, one row per day from ``first_day`` to ``last_day`` of a one-row frame."""
    return bounds.selectExpr("explode(sequence(first_day, last_day)) AS date_key").selectExpr(
        "date_key",
        "dayofmonth(date_key) AS day_of_month",
        "month(date_key) AS month_num",
        "date_format(date_key, 'MMMM') AS month_name",
        "quarter(date_key) AS quarter_num",
        "year(date_key) AS year_num",
        f"{fiscal_quarter_sql('date_key')} AS fiscal_quarter",
        "year(date_key) AS fiscal_year",
        "weekofyear(date_key) AS week_of_year",
        f"{week_ending_sql('date_key')} AS week_ending_date",
        "date_format(date_key, 'EEE') AS day_of_week",
        "weekday(date_key) >= 5 AS is_weekend",
        "date_key = last_day(date_key) AND month(date_key) % 3 = 0 AS is_quarter_end",
    )


def saturdays(start: dt.date, end: dt.date) -> list[dt.date]:
    """The Saturdays from ``start`` to ``end``, both counted."""
    first = start + dt.timedelta(days=(5 - start.weekday()) % 7)
    return [first + dt.timedelta(weeks=n) for n in range((end - first).days // 7 + 1)]
