"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import distinct, hashes, loaded, mix, padded, portions, slices
from cashtide.llm.common import text_of

_BITS = 20
_PREFIXES = range(3, 9)
_SUFFIXES = (3, 4)
_LANE = 64


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Tokens:
    """The letter runs of some texts: distinct ones with their features, and all of them in order."""

    features: np.ndarray  # one row of feature numbers per distinct token
    which: np.ndarray  # the distinct token of each token
    numbers: np.ndarray  # for each text its first token; one more entry than texts
    starts: np.ndarray  # in code points of the joined texts
    lens: np.ndarray
    bounds: np.ndarray  # where each text starts in the joined texts


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    return (mix(values + np.uint64(kind * 0x1000003)) >> np.uint64(64 - _BITS)).astype(np.int32)


def tokens(texts: Sequence[str]) -> Tokens:
    """Runs of ASCII letters and characters beyond ASCII, with hashes of the token, its beginnings and its ends."""
    joined = "\n".join([*map(lowered, texts), ""])
    data = joined.encode("utf-8", "replace")
    buf = padded(data)
    body = buf[: len(data)]
    letter = ((body >= 97) & (body <= 122)) | (body >= 128)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    starts, lens = edges[::2], edges[1::2] - edges[::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if len(data) == len(joined):
        points, sizes = starts, lens
    else:
        at = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        points, sizes = at[starts], at[starts + lens] - at[starts]
    numbers = np.searchsorted(points, bounds)
    columns = 1 + len(_PREFIXES) + len(_SUFFIXES)
    if not len(starts):
        return Tokens(np.zeros((0, columns), np.int32), np.zeros(0, np.int32), numbers, points, sizes, bounds)
    firsts, which = distinct(buf, starts, lens)
    s, n = starts[firsts], lens[firsts]
    found = [_slot(hashes(buf, s, n), 0)]
    for k in _PREFIXES:
        (head,) = loaded(buf, s, np.minimum(n, k), 1)
        found.append(_slot(head, k))
    for k in _SUFFIXES:
        m = np.minimum(n, k)
        (tail,) = loaded(buf, s + n - m, m, 1)
        found.append(_slot(tail, 16 + k))
    return Tokens(np.stack(found, axis=1), which.astype(np.int32), numbers, points.astype(np.int32), sizes.astype(np.int32), bounds)


Matrix = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _times(x: Matrix, y: Matrix) -> Matrix:
    """Products of 2 x 2 matrices, given as their four entries, scaled to sum 1."""
    a, b, c, d = x
    e, f, g, h = y
    out = (a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h)
    total = out[0] + out[1] + out[2] + out[3]
    return out[0] / total, out[1] / total, out[2] / total, out[3] / total


def _scan(products: Matrix) -> Matrix:
    """Products of all lanes up to each, by doubling."""
    out, reach = products, 1
    while reach < len(out[0]):
        joined = _times(tuple(x[:-reach] for x in out), tuple(x[reach:] for x in out))
        out = tuple(np.concatenate([x[:reach], y]) for x, y in zip(out, joined, strict=True))
        reach *= 2
    return out


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, Matrix]:
    """Forward and backward odds of state 1, and matrices, of a chain of two states over the tokens of many texts.

    ``scores`` favour state 1 at each token, ``first`` marks the first token of each text. A text's
    first matrix has two equal rows, so nothing passes from one text to the next. Lanes of a fixed
    number of tokens run in step; a scan over their products gives each lane what comes in.
    """
    n = len(scores)
    lanes = -(-n // _LANE)
    weight = np.exp(np.clip(scores, -30, 30))
    plain = (
        np.where(first, start[0], moves[0, 0]),
        np.where(first, start[1], moves[0, 1]) * weight,
        np.where(first, start[0], moves[1, 0]),
        np.where(first, start[1], moves[1, 1]) * weight,
    )
    grid = []
    for entry, fill in zip(plain, (1.0, 0.0, 0.0, 1.0), strict=True):
        whole = np.full(lanes * _LANE, fill)
        whole[:n] = entry
        grid.append(np.ascontiguousarray(whole.reshape(lanes, _LANE).T))
    rows = [tuple(g[i] for g in grid) for i in range(_LANE)]
    product = rows[0]
    for row in rows[1:]:
        product = _times(product, row)
    a, b, c, d = _scan(product)
    ahead = np.full(lanes, 0.5)  # the share of state 1
    ahead[1:] = ((b + d) / (a + b + c + d))[:-1]
    forward = np.empty((_LANE, lanes))
    for i, (a, b, c, d) in enumerate(rows):
        zero, one = (1 - ahead) * a + ahead * c, (1 - ahead) * b + ahead * d
        ahead = one / (zero + one)
        forward[i] = ahead
    # Backwards the transposed matrices run from the end.
    a, c, b, d = _scan(tuple(product[k][::-1] for k in (0, 2, 1, 3)))
    behind = np.full(lanes, 0.5)
    behind[:-1] = ((c + d) / (a + b + c + d))[::-1][1:]
    backward = np.empty((_LANE, lanes))
    for i in reversed(range(_LANE)):
        backward[i] = behind
        a, b, c, d = rows[i]
        zero, one = a * (1 - behind) + b * behind, c * (1 - behind) + d * behind
        behind = one / (zero + one)
    return forward.T.ravel()[:n], backward.T.ravel()[:n], plain


@dataclass
class Field:
    """A trained tagger: feature weights, log transitions, log start, and the line from marginals to a document's score."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    start: np.ndarray
    line: np.ndarray
    trained: int

    def marginals(self, t: Tokens) -> np.ndarray:
        """The probability that each token is toxic, given its whole text."""
        if not len(t.which):
            return np.zeros(0)
        each = self.weights[t.features].sum(axis=1) + self.bias
        first = np.zeros(len(t.which), dtype=bool)
        heads = t.numbers[:-1]
        first[heads[heads < t.numbers[1:]]] = True
        f, b, _ = forward_backward(each[t.which], first, np.exp(self.moves), np.exp(self.start))
        return f * b / (f * b + (1 - f) * (1 - b))

    def scores(self, t: Tokens, marginals: np.ndarray) -> np.ndarray:
        """One score per text: a logistic of its largest marginal and of its expected number of toxic tokens."""
        if not self.trained:
            return np.zeros(len(t.numbers) - 1)
        return 1 / (1 + np.exp(-np.clip(evidence(t, marginals) @ self.line, -30, 30)))


def evidence(t: Tokens, marginals: np.ndarray) -> np.ndarray:
    """For each text 1, the log odds of its largest marginal, and the log of the sum of its marginals."""
    n = len(t.numbers) - 1
    most, total = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(t.numbers[1:] > t.numbers[:-1])
    if len(full):
        most[full] = np.maximum.reduceat(marginals, t.numbers[full])
        total[full] = np.add.reduceat(marginals, t.numbers[full])
    most = np.clip(most, 1e-5, 1 - 1e-5)
    return np.stack([np.ones(n), np.log(most / (1 - most)), np.log(total + 1e-3)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
    return w


def train(texts: Sequence[str], labels: Sequence[int], least: int = 5, odds: float = 12.0, steps: int = 15) -> Field:
    """A field from labelled documents.

    Token labels come from document labels: a token of a toxic document is toxic if it or one of its
    beginnings or ends stands in at least ``least`` toxic documents and is ``odds`` times as frequent
    among them as among clean ones; tokens of clean documents are not. Toxic documents without such a
    token teach nothing about tokens. Then the likelihood of the label chains is climbed with
    forward-backward marginals. Last a logistic line is fitted from marginals to document labels, on
    each fourth document, which the steps before did not see. Copies of a text count once.
    """
    size = 1 << _BITS
    field = Field(np.zeros(size), -4.0, np.zeros((2, 2)), np.zeros(2), np.zeros(3), len(texts))
    once = dict(zip(texts, labels, strict=True))
    texts, aside = [t for i, t in enumerate(once) if i % 4], [t for i, t in enumerate(once) if not i % 4]
    y, y_aside = (np.array([once[t] for t in part], dtype=np.int64) for part in (texts, aside))
    if len(set(y.tolist())) < 2 or len(set(y_aside.tolist())) < 2:
        field.trained = 0
        return field
    blocks = [(tokens(texts[a:b]), y[a:b]) for a, b in portions(texts)]
    seen = np.zeros((2, size))
    for t, own in blocks:
        doc = np.repeat(np.arange(len(own)), np.diff(t.numbers))
        pairs = np.unique(doc * len(t.features) + t.which) if len(t.which) else np.zeros(0, np.int64)
        d, w = pairs // max(1, len(t.features)), pairs % max(1, len(t.features))
        slots = np.unique((d[:, None] * size + t.features[w]).ravel())
        for kind in (0, 1):
            seen[kind] += np.bincount((slots % size)[own[slots // size] == kind], minlength=size)
    share = (seen + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1)
    marked = (seen[1] >= least) & (share[1] >= odds * share[0])
    chains = []
    for t, own in blocks:
        doc = np.repeat(np.arange(len(own)), np.diff(t.numbers))
        toxic = (own[doc] == 1) & marked[t.features].any(axis=1)[t.which]
        hit = np.bincount(doc[toxic], minlength=len(own)) > 0
        used = (own == 0) | hit
        first = np.zeros(len(t.which), dtype=bool)
        heads = t.numbers[:-1]
        first[heads[heads < t.numbers[1:]]] = True
        chains.append((t, toxic.astype(np.int8), first, used[doc]))
    rare = seen.sum(axis=0) < least  # too rare to weigh
    push = np.full(size, 1e-8)
    push_moves, push_start, push_bias = np.full((2, 2), 1e-8), np.full(2, 1e-8), 1e-8
    field.moves = np.log(np.array([[0.99, 0.01], [0.9, 0.1]]))
    field.start = np.log(np.array([0.99, 0.01]))
    for _ in range(steps):
        slope, slope_bias = 1e-2 * field.weights, 0.0
        slope_moves, slope_start = np.zeros((2, 2)), np.zeros(2)
        for t, z, first, used in chains:
            if not len(z):
                continue
            each = field.weights[t.features].sum(axis=1) + field.bias
            f, b, m = forward_backward(each[t.which], first, np.exp(field.moves), np.exp(field.start))
            p = f * b / (f * b + (1 - f) * (1 - b))
            gap = np.where(used, p - z, 0.0)
            by_token = np.bincount(t.which, gap, minlength=len(t.features))
            for c in range(t.features.shape[1]):
                slope += np.bincount(t.features[:, c], by_token, minlength=size)
            slope_bias += gap.sum()
            inner = np.flatnonzero(~first & used)
            inner = inner[inner > 0]
            before, here = f[inner - 1], b[inner]
            pair = [q * e[inner] * r for q, r, e in zip((1 - before, 1 - before, before, before), (1 - here, here, 1 - here, here), m, strict=True)]
            total = sum(pair)
            expected = np.array([(q / total).sum() for q in pair])
            slope_moves += (expected - np.bincount(2 * z[inner - 1] + z[inner], minlength=4)).reshape(2, 2)
            heads = np.flatnonzero(first & used)
            slope_start += np.array([(1 - p[heads]).sum(), p[heads].sum()]) - np.bincount(z[heads], minlength=2)
        slope[rare] = 0
        push += slope * slope
        push_bias += slope_bias * slope_bias
        push_moves += slope_moves * slope_moves
        push_start += slope_start * slope_start
        field.weights -= 0.5 * slope / np.sqrt(push)
        field.bias -= 0.2 * slope_bias / np.sqrt(push_bias)
        field.moves -= 0.2 * slope_moves / np.sqrt(push_moves)
        field.start -= 0.2 * slope_start / np.sqrt(push_start)
    late = [tokens(aside[a:b]) for a, b in portions(aside)]
    field.line = _logistic(np.concatenate([evidence(t, field.marginals(t)) for t in late]), y_aside.astype(float))
    field.weights = field.weights.astype(np.float32)
    return field


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int, longest: int) -> DataFrame:
    """Up to ``most`` labelled documents of at most ``longest`` characters, by a hash of their ids; none that is held out.

    A bound on the hash, set from the number of labelled ids, leaves about half as many again before
    the least are taken, so that no task reads more than that few ids however many partitions there are.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, 1.5 * most / max(1, known.count()))
    bound = min(2**63 - 1, int(share * 2**64) - 2**63)
    # ``most`` rows at most, of two numbers each.
    drawn = known.where(F.xxhash64("doc_id") <= bound).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t")).join(F.broadcast(drawn), "doc_id")
    return rows.where(F.length("t") <= longest).dropDuplicates(["doc_id"])


def held_out(column: str):
    """Whether the checksum of an id, as text, is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 4000, longest: int = 20_000) -> Field:
    """A field trained on the driver from ``training_rows``: at most ``most`` x ``longest`` characters."""
    rows = training_rows(docs, labels, doc_id, text, label, most, longest).select("doc_id", "t", "y").collect()
    rows.sort(key=lambda r: str(r["doc_id"]))
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def tag(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, and starts, ends and marginals of its offending tokens.

    Offsets are code points. Whole texts are scored; a null text is empty, has no spans and gets the
    score of a text without tokens. A field without training gives 0. Only the id and the text are
    read; rows that repeat an id are scored each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fields = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    shared = spark.sparkContext.broadcast(field)  # 4 MB of weights, whatever the data
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, score double, starts array<int>, ends array<int>, marginals array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = batch.column("t").to_pylist()
            for a, b in portions(texts):
                t = tokens(texts[a:b])
                p = model.marginals(t)
                scores = model.scores(t, p)
                hits = np.flatnonzero(p >= least)
                of = np.searchsorted(t.numbers, hits, side="right") - 1
                starts: list[list[int]] = [[] for _ in range(b - a)]
                ends: list[list[int]] = [[] for _ in range(b - a)]
                values: list[list[float]] = [[] for _ in range(b - a)]
                for h, d in zip(hits.tolist(), of.tolist(), strict=True):
                    at = int(t.starts[h] - t.bounds[d])
                    starts[d].append(at)
                    ends[d].append(at + int(t.lens[h]))
                    values[d].append(float(p[h]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(scores, pa.float64()),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(ends, pa.list_(pa.int32())),
                        pa.array(values, pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "score", "starts", "ends", "marginals"],
                )

    return fields.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, field: Field, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``least``, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in portions(texts):
                t = tokens(texts[a:b])
                clean = model.scores(t, model.marginals(t)) < least
                yield batch.slice(a, b - a).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
