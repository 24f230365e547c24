"""Order-dependent operators.

Two kinds. Series at the grain of a day or a forecast run are short whatever the data size, and
use ordinary windows after aggregation. Series of raw rows can hold a third of a table in one
group; they are cut into ordered slices by a range shuffle, worked on slice by slice, and joined
up through one small row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.functions.amounts import ratio
from cashtide.operators.star import join_groups
from cashtide.session import stage

_SLICE = "__slice"


def _sliced(df: DataFrame, by: Sequence[str], order: Sequence[Column], slices: int | None) -> DataFrame:
    """``df`` with ``__slice``: rows of a lower slice come before those of a higher one.

    Slice numbers come from sampled bounds, so they are written down once and then only read.
    Without a number of slices there are as many as shuffle partitions, and adaptive execution
    merges neighbours while they are small.
    """
    columns = [*(F.col(c) for c in by), *order]
    ranged = df.repartitionByRange(slices, *columns) if slices else df.repartitionByRange(*columns)
    return stage(ranged.withColumn(_SLICE, F.spark_partition_id()), "slices")


def _before(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running_total(
    df: DataFrame, value: str, by: Sequence[str], key: str, name: str, slices: int | None = None
) -> DataFrame:
    """Sum of ``value`` over a group's rows up to each row in the order of ``key``, unique in its group."""
    cut = _sliced(df, by, [F.col(key).asc()], slices)
    offsets = cut.groupBy(*by, _SLICE).agg(F.sum(value).alias("__sum"))
    # NULL while nothing was seen, as in one window over the whole group.
    offsets = offsets.select(*by, _SLICE, F.sum("__sum").over(_before(by)).alias("__offset"))
    inside = Window.partitionBy(*by, _SLICE).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_groups(cut.withColumn(name, F.sum(value).over(inside)), offsets, [*by, _SLICE])
        .withColumn(name, F.coalesce(F.col(name) + F.col("__offset"), name, "__offset"))
        .drop(_SLICE, "__offset")
    )


def position(df: DataFrame, by: Sequence[str], key: str, name: str, slices: int | None = None) -> DataFrame:
    """A row's number, from 1, in its group in the order of ``key``, unique in its group."""
    return running_total(df.withColumn("__one", F.lit(1)), "__one", by, key, name, slices).drop("__one")


def fill_nulls(
    df: DataFrame, column: str, by: Sequence[str], key: str, forward: bool = True, slices: int | None = None
) -> DataFrame:
    """Replace NULLs by the nearest earlier value, or by the nearest later one with ``forward=False``."""
    direction = F.col(key).asc() if forward else F.col(key).desc()
    cut = _sliced(df, by, [direction], slices)
    value = F.col(column)
    known = F.when(value.isNotNull(), F.col(key))
    newest = F.max_by(value, known) if forward else F.min_by(value, known)
    carried = cut.groupBy(*by, _SLICE).agg(newest.alias("__last"))
    carried = carried.select(*by, _SLICE, F.last("__last", ignorenulls=True).over(_before(by)).alias("__carried"))
    inside = Window.partitionBy(*by, _SLICE).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("__filled", F.last(column, ignorenulls=True).over(inside))
    return (
        join_groups(filled, carried, [*by, _SLICE])
        .withColumn(column, F.coalesce("__filled", "__carried"))
        .select(*df.columns)
    )


def daily_balance(
    daily: DataFrame, day: str, net: str, by: Sequence[str] = (), opening: Column | None = None, name: str = "balance"
) -> DataFrame:
    """End-of-day balance on every row of a frame that is already one row per day and category.

    The frame spans days rows of the same day, which therefore all carry that day's closing balance.
    """
    span = Window.partitionBy(*by).orderBy(day).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    start = opening if opening is not None else F.lit(0)
    return daily.withColumn(name, (start + F.sum(net).over(span)).cast("decimal(28,2)"))


def trailing_share(
    daily: DataFrame, day: str, amount: str, category: str, days: int, by: Sequence[str] = (), name: str = "share"
) -> DataFrame:
    """A category's part of all categories' amounts in the ``days`` days up to and with its day.

    The frame has one row per day and category; NULL where the amounts of those days add up to zero.
    """
    reach = Window.orderBy(F.unix_date(day)).rangeBetween(1 - days, Window.currentRow)
    own, whole = F.sum(amount).over(reach.partitionBy(*by, category)), F.sum(amount).over(reach.partitionBy(*by))
    sums = daily.withColumn("__own", own).withColumn("__whole", whole)
    return sums.withColumn(name, ratio("__own", "__whole")).drop("__own", "__whole")


def daily_change(daily: DataFrame, day: str, balance: str, by: Sequence[str] = (), name: str = "change") -> DataFrame:
    """A daily balance less the one before; NULL on the first day."""
    return daily.withColumn(
        name, F.col(balance) - F.lag(balance).over(Window.partitionBy(*by).orderBy(day))
    )


def daily_fill(daily: DataFrame, day: str, column: str, by: Sequence[str] = (), backward_first: bool = False) -> DataFrame:
    """Fill the gaps of a daily series from the day before (then after), or the other way round."""
    span = Window.partitionBy(*by).orderBy(day)
    earlier = F.last(column, ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first(column, ignorenulls=True).over(span.rowsBetween(0, Window.unboundedFollowing))
    filled = F.coalesce(later, earlier) if backward_first else F.coalesce(earlier, later)
    return daily.withColumn(column, filled)


def ordinal_fraction(df: DataFrame, by: Sequence[str], order: str, name: str = "fraction") -> DataFrame:
    """Place of a row in its group over the group's size, for groups as short as the weeks of a run."""
    group = Window.partitionBy(*by)
    return (
        df.withColumn("ordinal", F.row_number().over(group.orderBy(order)))
        .withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn(name, F.col("ordinal") / F.col("n"))
    )
