"""Money, ratios and bands. Money stays DECIMAL so that totals tie out to the cent.

Arguments are SQL expressions over the columns at hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "DECIMAL(12,2)"
RATE = "DECIMAL(4,2)"
TOTAL = "DECIMAL(28,2)"
_WHOLE = "DECIMAL(38,0)"

# Age bands in days.
AGE_BOUNDS = (30, 60, 90)
AGE_LABELS = ("0-30", "31-60", "61-90", "90+")
PAST_DUE_BOUNDS = (0, 30, 60, 90)
PAST_DUE_LABELS = ("current", "1-30", "31-60", "61-90", "90+")


def total_sql(value: str, where: str | None = None) -> str:
    kept = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum({value}){kept} AS {TOTAL})"


def total(value: str, where: str | None = None) -> Column:
    """Sum of money, of one type in every query; NULL when no row meets ``where``."""
    return F.expr(total_sql(value, where))


def total_or_zero(value: str, where: str | None = None) -> Column:
    return F.expr(f"coalesce({total_sql(value, where)}, CAST(0 AS {TOTAL}))")


def ratio_sql(part: str, whole: str, digits: int | None = None) -> str:
    quotient = f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D)"
    return quotient if digits is None else f"round({quotient}, {digits})"


def ratio(part: str, whole: str, digits: int | None = None) -> Column:
    """Quotient in DOUBLE, NULL where the divisor is zero."""
    return F.expr(ratio_sql(part, whole, digits))


def portion_sql(amount: str, part: str, whole: str) -> str:
    """``amount * part / whole`` to the cent, halves away from zero, in whole-number arithmetic.

    ``part`` and ``whole`` are whole numbers; NULL where ``whole`` is zero.
    """
    above = f"2 * CAST(abs({amount}) * 100 AS {_WHOLE}) * CAST({part} AS {_WHOLE})"
    below = f"nullif(CAST({whole} AS {_WHOLE}), 0)"
    cents = f"(CAST({above} + {below} AS {_WHOLE}) div CAST(2 * {below} AS {_WHOLE}))"
    return f"CAST(CAST(if({amount} < 0, -{cents}, {cents}) AS DECIMAL(20,0)) * 0.01BD AS {TOTAL})"


def portion(amount: str, part: str, whole: str) -> Column:
    return F.expr(portion_sql(amount, part, whole))


def band_sql(value: str, bounds: Sequence[int], labels: Sequence[str]) -> str:
    """The band a number falls in: ``labels[n]`` up to and with ``bounds[n]``, the last one above all."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("one label more than bounds is needed")
    steps = " ".join(f"WHEN {value} <= {bound} THEN '{label}'" for bound, label in zip(bounds, labels, strict=False))
    return f"CASE {steps} WHEN {value} IS NOT NULL THEN '{labels[-1]}' END"


def bucketize(value: str, bounds: Sequence[int], labels: Sequence[str]) -> Column:
    return F.expr(band_sql(value, bounds, labels))


def padded_id(prefix: str, number: str, width: int) -> Column:
    """Ids such as ``SKU-00042``."""
    return F.expr(f"format_string('{prefix}-%0{width}d', {number})")


def swap_prefix(code: Column, old: str, new: str) -> Column:
    return F.regexp_replace(code, f"^{old}-", f"{new}-")
