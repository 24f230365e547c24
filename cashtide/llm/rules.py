"""Quality by a sparse ensemble of rules: tree paths over statistics, weighted by a lasso, compiled to Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import blank_words, distinct, padded, portions, slices
from cashtide.llm.common import text_of
from cashtide.llm.toxicity import held_out

#: Statistics of a text, in this order.
NAMES = (
    "words", "word_length", "words_per_line", "words_per_stop", "upper", "digits", "signs", "sign_runs",
    "lone_signs", "short_words", "long_words", "stops", "again", "kinds", "commonest", "line_kinds",
)

#: Of a rule: the number of a statistic, whether it must be at most the bound (else above it), and the bound.
Condition = tuple[int, bool, float]


def _sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``marks`` are set in each range between neighbouring bounds."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    if len(full):
        out[full] = np.add.reduceat(marks, bounds[full], dtype=np.int64)
    return out


def _shares(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    return np.divide(over, under, out=np.zeros(len(over)), where=under > 0)


def measures(texts: Sequence[str]) -> np.ndarray:
    """One row of ``NAMES`` per text.

    Characters are code points, words stand between blanks and the controls 9 to 13. Signs are ASCII
    characters that are neither letters, digits nor blanks; upper-case letters and digits are ASCII
    ones. Kinds are distinct ones, of words without regard to the case of A to Z. What would be divided by 0 is 0.
    """
    buf, starts, lens, numbers = blank_words(texts)
    raw = np.frombuffer("\n".join([*texts, ""]).encode(), dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    head = (raw & 0xC0) != 0x80
    line = raw == 10
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    sign = (raw < 128) & ~blank & ~upper & ~digit & ~((raw >= 97) & (raw <= 122))
    # Texts end at the line feeds that join them.
    sizes = np.array([len(t.encode()) + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    many = np.diff(numbers).astype(float)
    chars = _sums(head, bounds) - 1.0
    breaks = _sums(line, bounds).astype(float)
    points = np.concatenate([[0], np.cumsum(head)])
    signs = np.concatenate([[0], np.cumsum(sign)])
    long = points[starts + lens] - points[starts]
    lone = signs[starts + lens] - signs[starts] == lens
    runs = np.zeros(len(raw), dtype=bool)
    runs[:-1] = sign[:-1] & sign[1:]
    runs[1:] &= ~sign[:-1]
    ends = raw[starts + lens - 1] if len(starts) else raw[:0]
    stop = (ends == 46) | (ends == 33) | (ends == 63)
    which = distinct(buf, starts, lens)[1] if len(starts) else np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(numbers))
    same = np.zeros(len(which), dtype=bool)
    same[1:] = (which[1:] == which[:-1]) & (text[1:] == text[:-1])
    pairs, counts = np.unique(text * (len(which) + 1) + which, return_counts=True)
    own = pairs // (len(which) + 1)
    most = np.zeros(len(texts))
    np.maximum.at(most, own, counts)
    # Lines: what stands between line feeds, the last one of a text included.
    stops = np.flatnonzero(line)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    lines = distinct(padded(raw.tobytes()), begins, stops - begins)[1] if len(stops) else begins
    of = np.searchsorted(bounds, stops, side="right") - 1
    kinds_of_line = np.bincount(np.unique(of * (len(lines) + 1) + lines) // (len(lines) + 1), minlength=len(texts))
    per_word = lambda marks: _shares(_sums(marks, numbers), many)
    return np.stack(
        [
            many,
            _shares(points[bounds[1:]] - points[bounds[:-1]] - _sums(blank, bounds), many),
            _shares(many, breaks),
            many / (_sums(stop, numbers) + 1),
            _shares(_sums(upper, bounds), chars),
            _shares(_sums(digit, bounds), chars),
            _shares(_sums(sign, bounds), chars),
            _shares(_sums(runs, bounds), many),
            per_word(lone),
            per_word(long <= 3),
            per_word(long >= 14),
            per_word(stop),
            per_word(same),
            _shares(np.bincount(own, minlength=len(texts)), many),
            _shares(most, many),
            _shares(kinds_of_line, breaks),
        ],
        axis=1,
    )


def statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and all statistics of each text as doubles; a null text is empty."""
    fields = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{name} double' for name in NAMES)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("t").to_pylist()
            for a, b in portions(texts):
                found = measures(texts[a:b])
                columns = [pa.array(np.ascontiguousarray(found[:, c])) for c in range(len(NAMES))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=["doc_id", *NAMES])

    return fields.mapInArrow(run, schema)


@dataclass
class RuleSet:
    """A trained ensemble: conjunctions of conditions on statistics with their weights, and an intercept.

    Without rows of both labels there are no rules, and every text scores the same.
    """

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float
    trained: int

    def texts(self) -> list[str]:
        """The rules as SQL conditions."""
        return [
            " AND ".join(f"{NAMES[s]} {'<=' if below else '>'} {bound!r}" for s, below, bound in rule) for rule in self.rules
        ]

    def column(self) -> Column:
        """The probability of label 1 as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def fired(self) -> Column:
        """The rules that hold for a row, each as its condition, heaviest first."""
        order = sorted(range(len(self.rules)), key=lambda n: -abs(self.weights[n]))
        said = self.texts()
        each = [F.when(_holds(self.rules[n]), F.lit(said[n])) for n in order]
        return F.array_compact(F.array(*each).cast("array<string>"))


def _holds(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for s, below, bound in rule:
        out = out & ((F.col(NAMES[s]) <= bound) if below else (F.col(NAMES[s]) > bound))
    return out


def _bounds(column: np.ndarray, most: int = 32) -> np.ndarray:
    """Places to split a statistic at: middles between neighbouring values, as many rows between any two of them."""
    values = np.unique(column)
    if len(values) > most:
        values = np.unique(np.quantile(column, np.linspace(0, 1, most), method="nearest"))
    return (values[:-1] + values[1:]) / 2


def _tree(x: np.ndarray, bounds: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> list[tuple[tuple[Condition, ...], float]]:
    """A regression tree of Newton steps, as (path, step) of every leaf; inner paths come with a step of 0."""
    out: list[tuple[tuple[Condition, ...], float]] = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if len(path) < depth:
            for s, cuts in enumerate(bounds):
                if not len(cuts):
                    continue
                bins = np.searchsorted(cuts, x[rows, s])  # bin b: cuts[b-1] < value <= cuts[b]
                counts = np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1]
                gl = np.cumsum(np.bincount(bins, g[rows], len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins, h[rows], len(cuts) + 1))[:-1]
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                gain[(counts < least) | (len(rows) - counts < least)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], s, float(cuts[k]))
        if best is None:
            out.append((path, float(-gs / (hs + 1))))
            return
        if path:
            out.append((path, 0.0))
        _, s, cut = best
        low = x[rows, s] <= cut
        grow(rows[low], (*path, (s, True, cut)))
        grow(rows[~low], (*path, (s, False, cut)))

    grow(np.arange(len(x)), ())
    return out


def _meets(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for s, below, bound in rule:
        out &= (x[:, s] <= bound) if below else (x[:, s] > bound)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of the columns of ``r``, the intercept last: accelerated proximal steps on the mean logistic loss plus an L1 penalty."""
    a = np.concatenate([r, np.ones((len(r), 1))], axis=1)
    step = 4 * len(a) / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w, z, t = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        new = z - step * (a.T @ (_sigmoid(a @ z) - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * penalty)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, after
    return w


def _loss(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The mean logistic loss and its standard error."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    each = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    return float(each.mean()), float(each.std() / np.sqrt(len(each)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, seed: int = 5) -> RuleSet:
    """Rules from labelled statistics.

    Shallow trees are boosted, each on half of the rows; every path of theirs, to leaves and inner
    nodes, is a rule. A lasso logistic regression weighs the rules: its penalty is the largest whose
    loss on every fourth row, left out of trees and weights, is within one standard error of the least.
    The weights are then fitted to all rows at that penalty.
    """
    y = y.astype(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        return RuleSet([], [], float(np.log(share / (1 - share))) if len(y) else 0.0, 0)
    draw = np.random.default_rng(seed)
    late = np.arange(len(y)) % 4 == 3
    if len(set(y[late].tolist())) < 2 or len(set(y[~late].tolist())) < 2:
        late = np.zeros(len(y), dtype=bool)
    own, target = x[~late], y[~late]
    bounds = [_bounds(own[:, s]) for s in range(x.shape[1])]
    least = max(2, len(own) // 400)
    level = np.full(len(own), np.log(target.mean() / (1 - target.mean())))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = _sigmoid(level)
        rows = np.sort(draw.choice(len(own), max(1, len(own) // 2), replace=False))
        for path, value in _tree(own[rows], bounds, (p - target)[rows], (p * (1 - p))[rows], depth, least):
            if path:
                rules.setdefault(tuple(sorted(path)))
            if value:
                level += rate * value * _meets(own, path)
    names = list(rules)
    met = np.stack([_meets(x, rule) for rule in names], axis=1).astype(float) if names else np.zeros((len(x), 0))
    # Rules that hold for the same rows count once, the shortest of them; those that always or never hold teach nothing.
    first: dict[bytes, int] = {}
    for n in sorted(range(len(names)), key=lambda n: (len(names[n]), names[n])):
        if 0 < met[:, n].sum() < len(x):
            first.setdefault(met[:, n].tobytes(), n)
    chosen = sorted(first.values())
    names, met = [names[n] for n in chosen], met[:, chosen]
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(target.mean() / (1 - target.mean()))
    top = np.abs(met[~late].T @ (target.mean() - target)).max() / len(target) if names else 0.0
    tried = []
    for penalty in top * np.logspace(-0.3, -3, 12):
        w = _lasso(met[~late], target, penalty, w)
        part = late if late.any() else ~late
        tried.append((*_loss(_sigmoid(met[part] @ w[:-1] + w[-1]), y[part]), penalty))
    enough = sum(min(tried, default=(0.0, 0.0, 0.0))[:2])
    penalty = max((q for loss, _, q in tried if loss <= enough), default=0.0)
    w = _lasso(met, y, penalty, w)
    used = [n for n in range(len(names)) if abs(w[n]) > 1e-3]
    return RuleSet([names[n] for n in used], [float(w[n]) for n in used], float(w[-1]), len(y))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """Statistics and label ``y`` of about ``most`` labelled documents that are not held out, drawn by a hash of their ids.

    The bound on the hash comes from the number of labelled ids, so no task sees more than its share.
    A document whose id occurs more than once gives a row for each of its texts.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    space = 1 << 30
    bound = space * most // max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < F.lit(min(space, bound)))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    # About ``most`` rows of two numbers.
    rows = named.join(F.broadcast(drawn.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id"))
    found = statistics(rows.select(F.struct("id", "y").alias("key"), "t"), "key", "t")
    return found.select("doc_id.*", *NAMES)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 4000) -> RuleSet:
    """Rules trained on the driver from the statistics of about ``most`` documents; no text comes to the driver."""
    rows = training_rows(docs, labels, doc_id, text, label, most).collect()
    rows = sorted({tuple(r) for r in rows}, key=str)
    x = np.array([r[2:] for r in rows], dtype=float).reshape(-1, len(NAMES))
    return train(x, np.array([r[1] for r in rows], dtype=float))


def rate(docs: DataFrame, model: RuleSet, doc_id: str = "doc_id", text: str = "text", reasons: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id and score, with ``reasons`` also the rules that hold, as SQL conditions.

    Whole texts are read; a null text is empty and scores as one. Ids of any type, null or repeated,
    are carried along, and each row has a score of its own. Other columns are not read. An empty table
    gives no rows. Statistics come in Arrow batches, rules and score are Spark expressions; nothing is shuffled.
    """
    found = statistics(docs, doc_id, text)
    more = [model.fired().alias("reasons")] if reasons else []
    return found.select("doc_id", model.column().alias("score"), *more)
