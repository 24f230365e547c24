"""Periodic runs of words: a harmonic grid of pairs, extended by a difference cover and range minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import blank_words, distinct, portions, ragged, slices
from cashtide.llm.common import text_of

#: The differences of any two members cover every remainder of ``_CYCLE``.
_CYCLE = 21
_COVER = np.array([0, 1, 6, 8, 18])
_SIZE = len(_COVER)
#: Grid points that are looked at in one step.
_STEP = 1 << 20

SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _slots() -> np.ndarray:
    out = np.full(_CYCLE, -1)
    out[_COVER] = np.arange(_SIZE)
    return out


def _shifts() -> np.ndarray:
    """For two remainders the least shift that takes both into the cover."""
    out = np.zeros((_CYCLE, _CYCLE), dtype=np.int64)
    member = _slots() >= 0
    for a in range(_CYCLE):
        for b in range(_CYCLE):
            out[a, b] = next(d for d in range(_CYCLE) if member[(a + d) % _CYCLE] and member[(b + d) % _CYCLE])
    return out


_SLOT, _SHIFT = _slots(), _shifts()


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows, the first column counting most; equal rows share one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        ranked = c[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


class Extensions:
    """Longest common extensions of two places of one text, among many texts that stand in a row.

    ``words`` are numbers from 1, with a 0 behind each text; ``text`` is the number of the text at each
    place. Only suffixes at places whose remainder is in the cover are sorted: by their first words,
    then by doubling. A pair is compared word by word until both places are in the cover, which is
    less than one cycle; a range minimum over the sorted suffixes gives the rest.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * _CYCLE, dtype=words.dtype)])
        self._text = text
        self._n = n
        self._sorted = False

    def _sort(self) -> None:
        self._sorted = True
        m = -(-self._n // _CYCLE) * _SIZE
        places = self._place(np.arange(m))
        m = int(np.searchsorted(places, self._n))
        places = places[:m]
        bits = max(1, int(self.words.max()).bit_length())
        per = max(1, 62 // bits)
        columns = [self._text[places].astype(np.int64)]
        for first in range(0, _CYCLE, per):
            key = np.zeros(m, dtype=np.int64)
            for t in range(first, min(first + per, _CYCLE)):
                key = (key << bits) | self.words[places + t]
            columns.append(key)
        levels = [_dense(columns)]
        while m and levels[-1].max() < m - 1:
            # Behind the last place of a residue nothing follows.
            step = _SIZE << (len(levels) - 1)
            after = np.full(m, -1, dtype=np.int64)
            if step < m:
                after[: m - step] = levels[-1][step:]
            levels.append(_dense([levels[-1] * (m + 1) + after + 1]))
        self._rank = levels[-1]
        order = np.empty(m, dtype=np.int64)
        order[self._rank] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(max(0, m - 1), dtype=np.int64)
        for k in reversed(range(len(levels))):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            lcp[same] += _CYCLE << k
            a[same] += _SIZE << k
            b[same] += _SIZE << k
        lcp += self._direct(self._place(a), self._place(b), np.where(self._text_of(a, m) == self._text_of(b, m), _CYCLE, 0))
        self._least = [lcp.astype(np.int32)]
        while 2 << (len(self._least) - 1) <= len(lcp):
            last, half = self._least[-1], 1 << (len(self._least) - 1)
            self._least.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _place(sample: np.ndarray) -> np.ndarray:
        return sample // _SIZE * _CYCLE + _COVER[sample % _SIZE]

    def _text_of(self, sample: np.ndarray, m: int) -> np.ndarray:
        return self._text[np.minimum(self._place(np.minimum(sample, m - 1)), self._n - 1)]

    def _direct(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, ``limit`` of them at most (up to a cycle)."""
        out = np.zeros(len(i), dtype=np.int64)
        active = np.flatnonzero(limit > 0)
        t = 0
        while len(active):
            active = active[self.words[i[active] + t] == self.words[j[active] + t]]
            t += 1
            out[active] = t
            active = active[limit[active] > t]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on; i and j differ and are places of one text."""
        shift = _SHIFT[i % _CYCLE, j % _CYCLE]
        out = self._direct(i, j, shift)
        rest = np.flatnonzero(out == shift)
        if len(rest):
            if not self._sorted:
                self._sort()
            a, b = i[rest] + shift[rest], j[rest] + shift[rest]
            # A place behind the last text has no suffix, nor anything in common with another.
            inside = np.flatnonzero((a < self._n) & (b < self._n))
            rest, a, b = rest[inside], a[inside], b[inside]
            ranks = [self._rank[x // _CYCLE * _SIZE + _SLOT[x % _CYCLE]] for x in (a, b)]
            low, high = np.minimum(*ranks), np.maximum(*ranks)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                table = self._least[k]
                out[rest[at]] += np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and place (from the text's start) of all grid points, some at a time.

    Period q has the points 0, q, 2q, ... A run of ``times`` periods has one within its first q words,
    from which it goes on for more than (times - 2) * q words.
    """
    most = sizes // times
    text = np.repeat(np.arange(len(sizes)), most)
    period = ragged(np.ones(len(sizes), dtype=np.int64), most)
    count = np.maximum(0, (sizes[text] - period - ((times - 2) * period + 1)) // period + 1)
    ends = np.cumsum(count)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _STEP, side="right")))
        some = count[first:last]
        k = ragged(np.zeros(last - first, dtype=np.int64), some)
        q = np.repeat(period[first:last], some)
        yield np.repeat(text[first:last], some), q, k * q
        first = last


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Text, start, length and smallest period of every run, by text, start and period.

    ``words`` has the words' numbers from 1 of all texts, text after text, ``sizes`` their counts.
    """
    numbers = np.arange(len(sizes))
    heads = np.cumsum(sizes + 1) - (sizes + 1)
    whole = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)
    own = np.repeat(numbers, sizes + 1)
    whole[ragged(heads, sizes)] = words
    extend = Extensions(whole, own)
    ids = extend.words
    found = []
    for text, q, at in _grid(sizes, times):
        i = at + heads[text]
        # Before anything else the first words must agree.
        for t in range(min(3, times - 1)):
            same = np.flatnonzero(ids[i + t] == ids[i + t + q])
            text, q, i = text[same], q[same], i[same]
        if not len(i):
            continue
        ahead = extend(i, i + q)
        long = np.flatnonzero(ahead > (times - 2) * q)
        text, q, i, ahead = text[long], q[long], i[long], ahead[long]
        # The run's first grid point only: before it fewer than q words agree.
        room = i - heads[text]
        before = np.flatnonzero(room >= q)
        later = np.zeros(len(i), dtype=bool)
        later[before] = extend(i[before] - q[before], i[before]) >= q[before]
        text, q, i, ahead, room = (x[~later] for x in (text, q, i, ahead, room))
        low, high = np.zeros(len(i), dtype=np.int64), np.minimum(q - 1, room)
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = extend(i - middle, i - middle + q) >= middle
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        length = low + q + ahead
        kept = length >= np.maximum(least, times * q)
        found.append(np.stack([text, i - low - heads[text], length, q])[:, kept])
    out = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
    # A multiple of the smallest period gives the same stretch: the least one counts.
    out = out[:, np.lexsort(out[[3, 2, 1, 0]])]
    new = np.ones(out.shape[1], dtype=bool)
    new[1:] = (out[:3, 1:] != out[:3, :-1]).any(axis=0)
    out = out[:, new]
    return tuple(out[:, np.lexsort(out[[3, 1, 0]])])


def _joined(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, kept: np.ndarray, counts: np.ndarray) -> Iterator[str]:
    """For each text its kept words with one blank between them."""
    sizes = lens[kept] + 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    for first in range(0, len(kept), 100_000):
        last = min(len(kept), first + 100_000)
        out[ends[first] : ends[last]] = buf[ragged(starts[kept[first:last]], sizes[first:last])]
    out[ends[1:] - 1] = 32
    at = ends[np.cumsum(np.concatenate([[0], counts]))]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield out[a : max(a, b - 1)].tobytes().decode()


def _answer(texts: list[str], least: int, times: int) -> list[pa.Array]:
    buf, starts, lens, numbers = blank_words(texts, fold=False)
    sizes = np.diff(numbers)
    words = distinct(buf, starts, lens)[1] + 1 if len(starts) else np.zeros(0, dtype=np.int64)
    text, start, length, period = runs_of(words, sizes, least, times)
    # What a run repeats goes: all but its first period.
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, numbers[text] + start + period, 1)
    np.add.at(marks, numbers[text] + start + length, -1)
    stays = np.cumsum(marks)[:-1] == 0
    kept = np.flatnonzero(stays)
    counts = np.diff(np.searchsorted(kept, numbers))
    offsets = np.searchsorted(text, np.arange(len(sizes) + 1))
    entries = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return [
        pa.array(sizes, pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries),
        pa.array(list(_joined(buf, starts, lens, kept, counts)), pa.string()),
    ]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    Words stand between blanks and the controls 9 to 13 and are numbered from 0. ``runs`` lists start,
    length and smallest period of every stretch of at least ``least`` words and ``times`` periods that
    cannot be extended, by start, then period. ``collapsed`` is the text without the words that a run
    repeats, one blank between words. A null or empty text has no words, no runs and collapses to the
    empty text. Ids of any type, null or repeated, are carried along; each row has its own answer.
    Other columns are not read. An empty table gives no rows.

    Nothing is shuffled. About a million characters are worked on together; a longer text is worked on
    alone, in memory of some 200 bytes a word.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    fields = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("t").to_pylist()
            for a, b in portions(texts):
                answer = _answer(texts[a:b], least, times)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *answer], names=["doc_id", "n_words", "runs", "collapsed"]
                )

    return fields.mapInArrow(run, schema)


def run_digest(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` finds in one row of plain columns: counts, the run of most periods, and digests.

    Of runs with equal length / period the first one counts, then that of the smaller period. The
    comparison is of whole numbers.
    """
    most = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), "
        "(best, r) -> CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", most).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
