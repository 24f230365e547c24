"""Spelling variants: words one edit apart, found by k-d trees over their letter counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import staged, text_of

#: A run of letters: A to Z in either case and U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Dimensions of a vector: a to z, and the other characters by their remainder.
_OTHERS = 14
_DIMS = 26 + _OTHERS
#: Words up to this length are compared as rows of code points, longer ones one by one.
_WIDE = 64
#: Counts that a set of bits tells apart: at least 1, 2 and 3 of a letter.
_LEVELS = 3
#: Distances that one step of a leaf works out.
_STEP = 1 << 20


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts of each word, 255 at most: one edit changes one count by one, a replacement one up and one down."""
    lens = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    plain = (codes >= 97) & (codes <= 122)
    dim = np.where(plain, codes - 97, 26 + codes % _OTHERS)
    flat = np.bincount(np.repeat(np.arange(len(words)), lens) * _DIMS + dim, minlength=len(words) * _DIMS)
    return np.minimum(flat, 255).astype(np.uint8).reshape(len(words), _DIMS)


def _bits(points: np.ndarray) -> np.ndarray:
    """Counts as sets of bits, one for each letter and level: what one has more than the other is their difference."""
    reached = points[:, :, None] >= np.arange(1, _LEVELS + 1, dtype=np.uint8)
    packed = np.packbits(reached.reshape(len(points), -1), axis=1)
    out = np.zeros((len(points), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


@dataclass
class Tree:
    """A k-d tree: inner nodes split a dimension at ``<= cut``, leaves are numbered; boxes are of whole space."""

    dim: list[int] = field(default_factory=list)  # -1 in a leaf
    cut: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)  # children; in a leaf its number and its parts
    high: list[int] = field(default_factory=list)
    leaves: int = 0
    members: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, points: np.ndarray, most: int, keep: bool) -> Tree:
        """Split at the middle of the widest spread dimension until ``most`` points are left, or equal ones only."""
        tree = cls()

        def grow(rows: np.ndarray) -> int:
            node = len(tree.dim)
            for part in (tree.dim, tree.cut, tree.low, tree.high):
                part.append(-1)
            own = points[rows]
            spread = own.astype(np.float32).var(axis=0) if len(rows) > most else np.zeros(1)
            if spread.max(initial=0) <= 0:
                tree.low[node], tree.high[node] = tree.leaves, max(1, -(-len(rows) // most))
                tree.leaves += 1
                if keep:
                    tree.members.append(rows)
                return node
            d = int(spread.argmax())
            values = np.sort(own[:, d])
            cut = int(values[len(values) // 2])
            # Both sides get something, and the sides are as equal as values allow.
            choices = [c for c in (cut - 1, cut) if values[0] <= c < values[-1]]
            cut = min(choices, key=lambda c: abs(2 * int(np.searchsorted(values, c, side="right")) - len(values)))
            below = own[:, d] <= cut
            tree.dim[node], tree.cut[node] = d, cut
            tree.low[node], tree.high[node] = grow(rows[below]), grow(rows[~below])
            return node

        grow(np.arange(len(points)))
        return tree

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), dtype=np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.dim[node] < 0:
                out[rows] = self.low[node]
                continue
            below = points[rows, self.dim[node]] <= self.cut[node]
            stack += [(self.low[node], rows[below]), (self.high[node], rows[~below])]
        return out

    def reach(self, points: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the points that have a vector there within one count up and ``down`` counts down.

        That is a part of the L1 ball of radius 1 + ``down``. A point goes to the side of a split it is
        not on only if the distance from the box on that side stays within both limits; the box of
        a point is its path's bounds.
        """
        rows = np.arange(len(points))
        bottom, top = np.zeros(_DIMS, dtype=np.int16), np.full(_DIMS, 255, dtype=np.int16)
        wide = points.astype(np.int16)
        none = np.zeros(len(points), dtype=np.int16)
        stack = [(0, rows, none, none, bottom, top)]
        while stack:
            node, rows, ups, downs, bottom, top = stack.pop()
            if not len(rows):
                continue
            if self.dim[node] < 0:
                yield self.low[node], rows
                continue
            d, cut = self.dim[node], self.cut[node]
            value = wide[rows, d]
            # To the low side the count has to go down to the cut at most, to the high side above it.
            fewer = np.maximum(0, value - cut) - np.maximum(0, value - top[d])
            less = downs + np.maximum(0, fewer)
            ok = less <= down
            lower_top = top.copy()
            lower_top[d] = cut
            stack.append((self.low[node], rows[ok], ups[ok], less[ok], bottom, lower_top))
            extra = np.maximum(0, cut + 1 - value) - np.maximum(0, bottom[d] - value)
            more = ups + np.maximum(0, extra)
            ok = more <= 1
            higher_bottom = bottom.copy()
            higher_bottom[d] = cut + 1
            stack.append((self.high[node], rows[ok], more[ok], downs[ok], higher_bottom, top))


def _one_edit(a: str, b: str) -> bool:
    """Whether b is a with one character replaced, or with one more."""
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def _verified(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[j]), of one length each, are one replaced or one added character apart."""
    n, m = len(a[0]), len(b[0])
    if m > _WIDE:
        return np.array([_one_edit(a[x], b[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
    x, y = (np.array(w, dtype=f"<U{k}").view("<u4").reshape(len(w), k) for w, k in ((a, n), (b, m)))
    out = np.zeros(len(i), dtype=bool)
    for first in range(0, len(i), 1 << 18):
        part = slice(first, first + (1 << 18))
        p, q = x[i[part]], y[j[part]]
        if n == m:
            out[part] = (p != q).sum(axis=1) == 1
        else:
            ahead = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(axis=1)
            behind = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[part] = ahead + behind >= n
    return out


def near_pairs(stored: list[str], asked: list[str], leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of asked and stored words one edit apart, by a range search in a k-d tree of the stored ones.

    Stored words have one length, asked ones the same length or one character less. In a leaf the
    stored counts may exceed the asked ones by one letter in all; with the lengths given, that bounds
    the L1 distance by two, or by one. Counts above three are taken for three there, which only
    lowers distances.
    """
    if not stored or not asked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    down = 1 if len(stored[0]) == len(asked[0]) else 0
    points, queries = vectors(stored), vectors(asked)
    tree = Tree.build(points, leaf, keep=True)
    has, lacks = _bits(points), ~_bits(queries)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for number, rows in tree.reach(queries, down):
        own = tree.members[number]
        most = max(1, _STEP // len(rows))
        for first in range(0, len(own), most):
            part = own[first : first + most]
            wide = max(1, _STEP // len(part))
            for at in range(0, len(rows), wide):
                some = rows[at : at + wide]
                more = np.zeros((len(some), len(part)), dtype=np.uint8)
                for word in range(has.shape[1]):
                    more += np.bitwise_count(lacks[some, word][:, None] & has[part, word][None, :])
                q, p = np.nonzero(more <= 1)
                found.append((some[q], part[p]))
    i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    if not len(i):
        return i, j
    ok = _verified(asked, stored, i, j)
    return i[ok], j[ok]


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7) -> DataFrame:
    """(doc_id, word): every maximal run of at least ``shortest`` letters of every whole text, A to Z lower-cased.

    A null or empty text has none. Runs are not made distinct. Ids of any type are carried along.
    """
    low = F.translate(text_of(text), _UPPER, _LOWER)
    found = F.regexp_extract_all(low, F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("word"))


def vocabulary(runs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): distinct words of at least ``shortest`` code points that occur ``least`` times or more; null is none."""
    counted = runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def cells(words: DataFrame, sample: int, cell: int) -> dict[int, Tree]:
    """For each length of words a k-d tree whose leaves hold about ``cell`` words, from about ``sample`` words' vectors.

    The sample is drawn by a hash of the words and comes to the driver: ``sample`` x 40 bytes. A length
    without a word in it is one cell; equal vectors that are too many for a leaf are cut into parts.
    """
    count = words.count()
    share = min(1.0, sample / max(1, count))
    space = 1 << 30
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(space)) < F.lit(int(space * share))) if share < 1 else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(w) for w in own], pa.int64()), pa.array([v.tobytes() for v in vectors(own)], pa.binary())],
                    names=["size", "vector"],
                )

    rows = drawn.select("word").mapInArrow(run, "size long, vector binary").toArrow()
    sizes = np.asarray(rows["size"])
    flat = np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype=np.uint8).reshape(-1, _DIMS)
    most = max(16, int(cell * share))
    return {int(n): Tree.build(flat[sizes == n], most, keep=False) for n in np.unique(sizes)}


def near_words(words: DataFrame, sample: int = 100_000, cell: int = 8192) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words of (word, n) that are one edit apart.

    One edit is one character inserted, deleted or replaced. It changes the L1 distance of letter counts
    by at most two. Words of one length lie in the cells of a k-d tree over those counts. A word is
    stored in its own cell, and asks in the cells of words of its length, and of one character more,
    whose boxes its ball meets: other cells hold nothing near. In each cell, which is one group, a
    finer tree answers, and the letters' order decides. A cell with more equal vectors than it should
    hold is several groups, by a hash of the stored words, each of which is asked.
    """
    trees = cells(words, sample, cell)
    schema = "size long, cell long, part int, stored boolean, word string, n long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {size: np.array([h for d, h in zip(t.dim, t.high, strict=True) if d < 0]) for size, t in trees.items()}
        # Leaves are numbered in the order in which they were made.
        for batch in batches:
            own, counts = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
            if not own:
                continue
            lens, points = np.array([len(w) for w in own]), vectors(own)
            out: list[tuple[np.ndarray, np.ndarray, int, np.ndarray, bool]] = []
            for size in np.unique(lens):
                rows = np.flatnonzero(lens == size)
                tree = trees.get(int(size))
                home = tree.home(points[rows]) if tree else np.zeros(len(rows), dtype=np.int64)
                many = parts[int(size)][home] if tree else np.ones(len(rows), dtype=np.int64)
                salt = np.array([hash_of(own[r]) % m for r, m in zip(rows.tolist(), many.tolist(), strict=True)], dtype=np.int64)
                out.append((rows, home, int(size), salt, True))
                for target in (int(size), int(size) + 1):
                    tree = trees.get(target)
                    reached = tree.reach(points[rows], 1 if target == size else 0) if tree else [(0, np.arange(len(rows)))]
                    for leaf, some in reached:
                        for part in range(int(parts[target][leaf]) if tree else 1):
                            full = np.full(len(some), leaf, dtype=np.int64)
                            out.append((rows[some], full, target, np.full(len(some), part, dtype=np.int64), False))
            take = np.concatenate([o[0] for o in out])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(o[0]), o[2]) for o in out]), pa.int64()),
                    pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                    pa.array(np.concatenate([o[3] for o in out]), pa.int32()),
                    pa.array(np.concatenate([np.full(len(o[0]), o[4]) for o in out]), pa.bool_()),
                    batch.column("word").take(pa.array(take)),
                    pa.array(counts[take], pa.int64()),
                ],
                names=["size", "cell", "part", "stored", "word", "n"],
            )

    def search(group: pa.Table) -> pa.Table:
        word, n = np.array(group["word"].to_pylist(), dtype=object), np.asarray(group["n"])
        stored = np.asarray(group["stored"])
        held, asked = np.flatnonzero(stored), np.flatnonzero(~stored)
        size = int(group["size"][0].as_py())
        pairs = []
        for k in (size, size - 1):
            some = asked[[len(w) == k for w in word[asked]]] if len(asked) else asked
            i, j = near_pairs(word[held].tolist(), word[some].tolist())
            if k == size:  # each word of the length asks: both orders are found already
                pairs.append((some[i], held[j]))
            else:
                pairs += [(some[i], held[j]), (held[j], some[i])]
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        return pa.table(
            {
                "word": pa.array(word[a].tolist(), pa.string()), "n": pa.array(n[a], pa.int64()),
                "near": pa.array(word[b].tolist(), pa.string()), "near_n": pa.array(n[b], pa.int64()),
            }
        )

    dealt = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(deal, schema)
    return dealt.groupBy("size", "cell", "part").applyInArrow(search, "word string, n long, near string, near_n long")


def hash_of(word: str) -> int:
    """A number for a word that is the same in every process."""
    out = 7
    for c in word:
        out = (out * 31 + ord(c)) & 0x7FFFFFFF
    return out


def variants(words: DataFrame, times: int = 10, sample: int = 100_000, cell: int = 8192) -> DataFrame:
    """For each row of ``words`` (word, n; distinct words): form, root, n_near and form_n.

    Near words are one edit apart. A word's form is the near word with the largest n, the smallest in
    code-point order of those with equal n, if it occurs ``times`` as often; else null. Its root is
    the last word reached by forms, the word itself if it has none. n_near counts near words. An empty
    table gives no rows.
    """
    words = staged(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words, sample, cell)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    found = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best.minus") >= times * F.col("n")
    found = staged(
        found.select(
            "word", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n")
        ),
        "near",
    )
    # A form occurs ``times`` as often as its word, so chains are short; each round doubles the way.
    steps = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = steps.selectExpr("word AS root", "root AS further")
        jumped = steps.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        jumped = staged(jumped, "roots")
        steps = jumped.select("word", "root")
        if jumped.where("further is not null").isEmpty():
            break
    out = words.join(found, "word", "left").join(steps, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """``variants`` of the words of whole texts; other columns are not read, and null ids count like any other."""
    return variants(vocabulary(letter_runs(docs, doc_id, text, shortest), shortest, least), times)
