"""Metric views: named fields and measures over one fact, compiled to DataFrame operations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL
from cashtide.operators.star import Lookup, Partial, aggregate_by_attributes, aggregate_by_sets, at_latest, star_join

_ANY = object()
Condition = Any | Sequence[Any] | Callable[[Column], Column]


@dataclass(frozen=True)
class Field:
    """Something to group or filter by: ``fact.column`` or ``lookup.column``."""

    name: str
    source: str
    label: str = ""
    synonyms: tuple[str, ...] = ()

    @property
    def lookup(self) -> str:
        return self.source.split(".", 1)[0]


@dataclass(frozen=True)
class Measure:
    """An aggregate of a fact column: ``sum``, ``count`` or ``avg``, of the rows that meet ``where``.

    ``where`` is a SQL condition on ``fact.column``. Sums come as ``type``.
    """

    name: str
    kind: str
    column: str | None = None
    where: str | None = None
    type: str = TOTAL
    label: str = ""
    synonyms: tuple[str, ...] = ()
    format: str = ""

    def partials(self) -> list[Partial]:
        value = "1" if self.column is None else f"fact.{self.column}"
        kept = f" FILTER (WHERE {self.where})" if self.where else ""
        if self.kind == "count":
            return [Partial(self.name, F.expr(f"count({value}){kept}"), "sum")]
        parts = [Partial(self.name, F.expr(f"sum({value}){kept}"), "sum")]
        if self.kind == "avg":
            parts.append(Partial(f"{self.name}__n", F.expr(f"count({value}){kept}"), "sum"))
        return parts

    def result(self) -> str:
        if self.kind == "count":
            return f"CAST(coalesce({self.name}, 0) AS BIGINT) AS {self.name}"
        if self.kind == "avg":
            return f"CAST({self.name} AS DOUBLE) / nullif({self.name}__n, 0) AS {self.name}"
        return f"CAST({self.name} AS {self.type}) AS {self.name}"


@dataclass(frozen=True)
class Composed:
    """A SQL expression over other measures, taken after grouping."""

    name: str
    expression: str
    needs: tuple[str, ...]
    label: str = ""
    synonyms: tuple[str, ...] = ()
    format: str = ""


@dataclass(frozen=True)
class MetricView:
    """One fact with its lookups, fields and measures.

    ``latest_by`` names the time field of a snapshot: a query that does not group by it is answered
    for one snapshot only, the newest that meets its filters, since levels do not add up over
    time. Without a filter on it that is ``latest``, where given. A view whose snapshots are worked
    out on demand has ``builder``, which makes the fact for some of ``weeks``; ``source`` has all of them.
    """

    name: str
    source: DataFrame
    fields: tuple[Field, ...]
    measures: tuple[Measure | Composed, ...]
    lookups: tuple[Lookup, ...] = ()
    filter: str | None = None
    latest_by: str | None = None
    latest: dt.date | None = None
    builder: Callable[[Sequence[dt.date]], DataFrame] | None = None
    weeks: tuple[dt.date, ...] = ()
    comment: str = ""
    _index: Mapping[str, Any] = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        names = [item.name for item in (*self.fields, *self.measures)]
        # A field and a measure may not share a name, or a query could mean either.
        repeated = {name for name in names if names.count(name) > 1}
        if repeated:
            raise ValueError(f"{self.name}: names used twice: {sorted(repeated)}")
        object.__setattr__(self, "_index", {item.name: item for item in (*self.fields, *self.measures)})

    def field(self, name: str) -> Field:
        found = self._index.get(name)
        if not isinstance(found, Field):
            raise KeyError(f"{self.name} has no field {name!r}")
        return found

    def measure(self, name: str) -> Measure | Composed:
        found = self._index.get(name)
        if found is None or isinstance(found, Field):
            raise KeyError(f"{self.name} has no measure {name!r}")
        return found

    def find(self, words: str) -> str:
        """The field or measure that goes by a name, display name or synonym."""
        asked = words.strip().lower()
        for item in self._index.values():
            if asked in {item.name.lower(), item.label.lower(), *(s.lower() for s in item.synonyms)}:
                return item.name
        raise KeyError(f"{self.name} has nothing called {words!r}")

    def describe(self, spark: SparkSession) -> DataFrame:
        """Names, kinds, display names, synonyms and formats as a table."""
        rows = [
            (i.name, "field" if isinstance(i, Field) else "measure", i.label, list(i.synonyms), getattr(i, "format", ""))
            for i in self._index.values()
        ]
        return spark.createDataFrame(
            rows, "name string, kind string, display_name string, synonyms array<string>, format string"
        )


def _condition(column: Column, wanted: Condition) -> Column:
    if callable(wanted) and not isinstance(wanted, Column):
        return wanted(column)
    if isinstance(wanted, (list, tuple, set, frozenset)):
        return column.isin(list(wanted))
    return column.isNull() if wanted is None else column == F.lit(wanted)


def _atoms(view: MetricView, names: Sequence[str]) -> list[Measure]:
    """The plain measures behind a list of measures, each once."""
    found: dict[str, Measure] = {}

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"{view.name}: measure {name!r} is defined by itself")
        measure = view.measure(name)
        if isinstance(measure, Composed):
            for needed in measure.needs:
                visit(needed, (*path, name))
        else:
            found[name] = measure

    for name in names:
        visit(name, ())
    return list(found.values())


def _evaluate(view: MetricView, grouped: DataFrame, names: Sequence[str], done: set[str]) -> DataFrame:
    for name in names:
        measure = view.measure(name)
        if isinstance(measure, Composed) and name not in done:
            grouped = _evaluate(view, grouped, measure.needs, done)
            grouped = grouped.withColumn(name, F.expr(measure.expression))
            done.add(name)
    return grouped


def _metadata(item: Field | Measure | Composed) -> dict[str, Any]:
    return {
        "display_name": item.label or item.name,
        "synonyms": list(item.synonyms),
        "format": getattr(item, "format", ""),
    }


def _weeks(view: MetricView, dims: Sequence[str], wanted: Condition) -> list[dt.date] | None:
    """The snapshots that a query needs, where its filter names them; None for all."""
    listed = list(wanted) if isinstance(wanted, (list, tuple, set, frozenset)) else [wanted]
    if wanted is not _ANY and not all(isinstance(d, dt.date) for d in listed):
        return None
    known = sorted(view.weeks if wanted is _ANY else set(listed) & set(view.weeks))
    return known if view.latest_by in dims else known[-1:]


def metric_query(
    view: MetricView,
    dims: Sequence[str],
    measures: Sequence[str],
    where: Mapping[str, Condition] | None = None,
    sets: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Group a view by fields and evaluate measures; only the lookups in use are joined.

    ``where`` maps fields to a value, a list of values, or a function from a column to a condition.
    ``sets`` asks for several grains at once, each a subset of ``dims``: the result then has
    ``grouping_id`` behind its fields (see ``aggregate_by_sets``), composed measures are taken at every
    grain, and a level is that of one snapshot at each grain that does not name the time.
    """
    where = dict(where or {})
    used = [view.field(name) for name in (*dims, *where)]
    source = view.source
    if view.latest_by is not None and view.builder is not None:
        weeks = _weeks(view, dims, where.get(view.latest_by, _ANY))
        # Only the snapshots that the query asks for are worked out.
        source = source if weeks is None else view.builder(weeks) if weeks else source.limit(0)
    fact = source if view.filter is None else source.filter(view.filter)
    level = None
    if view.latest_by is not None and view.latest_by not in dims:
        time = view.field(view.latest_by).source.split(".", 1)[1]
        wanted = where.pop(view.latest_by, _ANY)
        if wanted is _ANY:
            fact = at_latest(fact, time, view.latest)
        elif isinstance(wanted, dt.date):
            fact = fact.filter(F.col(time) == F.lit(wanted))
        elif view.builder is not None and weeks:
            fact = fact.filter(F.col(time) == F.lit(weeks[-1]))
        else:
            fact = at_latest(fact.filter(_condition(F.col(time), wanted)), time)
    elif view.latest_by is not None and sets is not None and not all(view.latest_by in group for group in sets):
        time = view.field(view.latest_by).source.split(".", 1)[1]
        wanted = where.get(view.latest_by, _ANY)
        if wanted is _ANY and view.latest is not None:
            newest = F.lit(view.latest)
        elif isinstance(wanted, dt.date):
            newest = F.lit(wanted)
        else:
            kept = fact if wanted is _ANY else fact.filter(_condition(F.col(time), wanted))
            newest = kept.agg(F.max(time)).scalar()
        level = (view.latest_by, F.col(view.latest_by) == newest)
    # Conditions on the fact go first; the others need their dimension.
    own = [f for f in used if f.lookup == "fact"]
    outer: Column | None = None
    fact = fact.alias("fact")
    for name, wanted in where.items():
        item = view.field(name)
        condition = _condition(F.col(item.source), wanted)
        if item in own:
            fact = fact.filter(condition)
        else:
            outer = condition if outer is None else outer & condition
    needed = {f.lookup for f in used} - {"fact"}
    lookups = [lookup for lookup in view.lookups if lookup.name in needed]
    atoms = _atoms(view, measures)
    by = [(name, view.field(name).source) for name in dims]
    partials = [partial for atom in atoms for partial in atom.partials()]
    if sets is None:
        grouped, keys = aggregate_by_attributes(fact, lookups, by, partials, keep=outer), list(dims)
    else:
        grouped, keys = aggregate_by_sets(fact, lookups, by, sets, partials, keep=outer, level=level), [*dims, "grouping_id"]
    plain = grouped.selectExpr(*keys, *(atom.result() for atom in atoms))
    evaluated = _evaluate(view, plain, measures, set())
    return evaluated.select(
        *(F.col(name).alias(name, metadata=_metadata(view.field(name))) for name in dims),
        *keys[len(dims) :],
        *(F.col(name).alias(name, metadata=_metadata(view.measure(name))) for name in measures),
    )


def flattened(view: MetricView) -> DataFrame:
    """A view's rows with all fields resolved, for SQL over them."""
    fact = view.source if view.filter is None else view.source.filter(view.filter)
    joined = star_join(fact, view.lookups)
    inputs = dict.fromkeys(m.column for m in view.measures if isinstance(m, Measure) and m.column)
    names = {f.name for f in view.fields}
    return joined.select(
        *(F.col(f.source).alias(f.name) for f in view.fields),
        *(F.col(f"fact.{column}").alias(column) for column in inputs if column not in names),
    )
