"""Facts and the dimensions they point at."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "fact"


@dataclass(frozen=True)
class Lookup:
    """A dimension joined many-to-one; its columns are reached as ``name.column``."""

    name: str
    table: DataFrame
    fact_key: str
    dim_key: str


def check_unique(df: DataFrame, key: str) -> None:
    """Raise when ``key`` repeats: a many-to-one join on it would multiply the fact."""
    repeated = df.groupBy(key).count().filter("count > 1").select(key).first()
    if repeated is not None:
        raise ValueError(f"{key} is not unique: {repeated[0]!r} occurs more than once")


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row per key; a key that repeats is an error when rows are computed.

    Dimensions pass through one aggregation for this. The key itself carries the check, so column
    pruning cannot remove it. NULL keys match nothing and may repeat.
    """
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(c) for c in others))
    message = F.concat(F.lit(f"{key.strip('_')} is not unique: "), F.col(key).cast("string"))
    alone = F.when(F.col("__n") == 1, F.col(key)).when(F.col(key).isNotNull(), F.raise_error(message))
    return grouped.withColumn(key, alone).select(*df.columns)


#: A key that holds more than one in this many rows is hot, so there are fewer hot keys than that.
HOT = 1024


def _salted(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """``fact`` with ``__salt`` and ``dim`` with ``__part``: 0 but for hot keys, whose rows are spread and repeated."""
    keys = fact.select(F.col(fact_key).alias("__hot"))
    rows = keys.agg(F.count(F.lit(1))).scalar()
    hot = keys.filter("__hot IS NOT NULL").groupBy("__hot").agg(F.count(F.lit(1)).alias("__n"))
    # Bounded by HOT, whatever the tables.
    hot = F.broadcast(hot.filter(F.col("__n") * HOT > rows).select("__hot"))
    parts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dim = dim.join(hot, F.col(dim_key) == F.col("__hot"), "left").withColumn("__part", F.explode(parts)).drop("__hot")
    own = F.pmod(F.xxhash64(*(F.col(c) for c in fact.columns)), F.lit(salts)).cast("int")
    spread = fact.join(hot, F.col(fact_key) == F.col("__hot"), "left")
    alone = F.col(fact_key).isNotNull() & F.col("__hot").isNull()
    return spread.withColumn("__salt", F.when(alone, 0).otherwise(own)).drop("__hot"), dim


def salted_lookup(fact: DataFrame, lookup: Lookup, columns: Sequence[str], salts: int = 32) -> DataFrame:
    """``fact`` with ``columns`` of a small-grained dimension, row by row, for keys that hold many rows.

    Rows of a hot key, and those without a key, are spread over ``salts`` parts, and the dimension's
    rows of hot keys are repeated as often, so a key with a third of all rows is that many tasks.
    All other keys stay one row of the dimension, whose size is then what Spark takes it for when it
    decides on a broadcast. Keys are counted in a pass of their own, over the key alone. A key that
    repeats in the dimension is an error when the result is computed.
    """
    dim = unique_by(lookup.table.select(F.col(lookup.dim_key).alias("__key"), *columns), "__key")
    spread, dim = _salted(fact, dim, lookup.fact_key, "__key", salts)
    condition = (spread[lookup.fact_key] == dim["__key"]) & (spread["__salt"] == dim["__part"])
    return spread.join(dim, condition, "left").drop("__key", "__part", "__salt")


def star_join(fact: DataFrame, lookups: Iterable[Lookup], how: str = "left", check: bool = False) -> DataFrame:
    """Join dimensions to a fact, which is reached as ``fact.column``.

    No broadcast hint is given: Catalyst broadcasts a dimension whose size it knows to be under
    the limit, looks again at run time, and otherwise sort-merges with hot partitions split.
    """
    joined = fact.alias(FACT)
    for lookup in lookups:
        if check:
            check_unique(lookup.table, lookup.dim_key)
        condition = F.col(f"{FACT}.{lookup.fact_key}") == F.col(f"{lookup.name}.{lookup.dim_key}")
        joined = joined.join(lookup.table.alias(lookup.name), condition, how)
    return joined


@dataclass(frozen=True)
class Partial:
    """An aggregate that can be taken in two steps: ``first`` on fact rows, ``again`` on its results."""

    name: str
    first: Column
    again: str  # "sum", "min", "max"

    def merged(self, where: Column | None = None) -> Column:
        """The second step, of the first step's results that meet a condition."""
        value = F.col(self.name) if where is None else F.when(where, F.col(self.name))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.again](value).alias(self.name)


def sums(**inputs: str) -> list[Partial]:
    """Named sums of SQL expressions on ``fact.column``; a plain name means that column of the fact."""
    return [
        Partial(name, F.expr(f"sum({FACT}.{value})" if value.isidentifier() else f"sum({value})"), "sum")
        for name, value in inputs.items()
    ]


def aggregate_by_attributes(
    fact: DataFrame,
    lookups: Sequence[Lookup],
    by: Sequence[tuple[str, str]],
    partials: Sequence[Partial],
    keep: Column | None = None,
    carry: Sequence[str] = (),
    how: str = "left",
    grain_first: bool = True,
) -> DataFrame:
    """Aggregate a fact by attributes of the fact and its dimensions.

    ``by`` pairs each output name with where it is found (``fact.column`` or ``lookup.column``);
    ``keep`` filters the joined rows and may use dimension columns and the fact columns in
    ``carry``.

    The fact is first aggregated at the grain of its foreign keys, so that a key holding a third of
    the rows reaches a shuffled join as a single row. A caller whose fact holds few rows per key
    can pass ``grain_first=False``; then rows are joined and aggregated once. A dimension in which
    a key repeats would multiply the fact, and is an error when the result is computed.
    """
    lookups = [replace(lookup, table=unique_by(lookup.table, lookup.dim_key)) for lookup in lookups]
    if not lookups or not grain_first:
        joined = star_join(fact, lookups, how)
        if keep is not None:
            joined = joined.filter(keep)
        keys = [F.col(source).alias(name) for name, source in by]
        return joined.groupBy(*keys).agg(*(p.first.alias(p.name) for p in partials))
    own = [source.split(".", 1)[1] for _, source in by if source.startswith(FACT + ".")]
    grain = list(dict.fromkeys([*own, *carry, *(lookup.fact_key for lookup in lookups)]))
    small = fact.alias(FACT).groupBy(*grain).agg(*(p.first.alias(p.name) for p in partials))
    joined = star_join(small, lookups, how)
    if keep is not None:
        joined = joined.filter(keep)
    keys = [F.col(source).alias(name) for name, source in by]
    return joined.groupBy(*keys).agg(*(p.merged() for p in partials))


def aggregate_by_sets(
    fact: DataFrame,
    lookups: Sequence[Lookup],
    by: Sequence[tuple[str, str]],
    sets: Sequence[Sequence[str]],
    partials: Sequence[Partial],
    keep: Column | None = None,
    carry: Sequence[str] = (),
    level: tuple[str, Column] | None = None,
) -> DataFrame:
    """``aggregate_by_attributes`` at several grains in one pass, with ``grouping_id`` to tell them apart.

    ``sets`` names the fields of ``by`` of each grain. The fact is first summed at the finest grain;
    each of those sums is then repeated once per set and summed again, so no set reads the fact
    anew. Bit k of ``grouping_id``, counted from the last field, is set where a grain leaves that field
    out: its NULL then means all values, where otherwise it means an unknown one.

    ``level`` is for sums that do not add up over time: the time field's name and a condition on it
    that the newest rows meet. A grain without the time field sums those rows only, and has no group
    where there are none.
    """
    names = [name for name, _ in by]
    unknown = {name for group in sets for name in group} - set(names)
    if unknown or len({frozenset(group) for group in sets}) < len(sets) or not sets:
        raise ValueError(f"sets of fields must be different and name fields of the query: {sorted(unknown)}")
    fine = aggregate_by_attributes(fact, lookups, by, partials, keep, carry)
    # The fields come again under other names: the repeated ones are NULL where a set leaves them out.
    inner = fine.select(*(F.col(name).alias(f"__{name}") for name in names), *(F.col(name) for name in names), *(p.name for p in partials))
    grouped = inner.groupingSets([[F.col(f"__{name}") for name in group] for group in sets], *(F.col(f"__{name}") for name in names))
    number = F.grouping_id(*(F.col(f"__{name}") for name in names)).cast("bigint").alias("grouping_id")
    if level is None:
        found = grouped.agg(number, *(p.merged() for p in partials))
    else:
        time, newest = level
        every = [p.merged().alias(f"__all_{p.name}") for p in partials]
        latest = [p.merged(newest).alias(f"__new_{p.name}") for p in partials]
        found = grouped.agg(number, F.count(F.when(newest, 1)).alias("__seen"), F.grouping(f"__{time}").alias("__over"), *every, *latest)
        found = found.filter("__over = 0 OR __seen > 0").withColumns(
            {p.name: F.when(F.col("__over") == 0, F.col(f"__all_{p.name}")).otherwise(F.col(f"__new_{p.name}")) for p in partials}
        )
    return found.select(*(F.col(f"__{name}").alias(name) for name in names), "grouping_id", *(p.name for p in partials))


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns, NULL being a group like any other, so that no group is lost."""
    if not by:
        raise ValueError("at least one group column is needed")
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in by})
    joined = left.join(renamed, F.expr(" AND ".join(f"`{c}` <=> `__{c}`" for c in by)), how)
    return joined.drop(*(f"__{c}" for c in by))


def at_latest(df: DataFrame, time_col: str, latest: dt.date | None = None) -> DataFrame:
    """Only the newest snapshot; pass ``latest`` where it is known, to save a pass over the table."""
    if latest is not None:
        return df.filter(F.col(time_col) == F.lit(latest))
    return df.filter(F.col(time_col) == df.agg(F.max(time_col)).scalar())


def side_by_side(frames: Iterable[DataFrame]) -> DataFrame:
    """One-row frames as the columns of one row, without a join."""
    frames = list(frames)
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*(F.max(name).alias(name) for name in stacked.columns))
