"""Vector bin packing of tokenized documents into training sequences."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import distinct, portions, ragged
from cashtide.llm.common import text_of
from cashtide.llm.transducer import Cutter, byte_alphabet


class TokenIds:
    """Ids of texts as the tokenizers library gives them for a byte-level vocabulary file.

    Texts are cut into words block by block, and the library merges each distinct word once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._cutter = Cutter(self._tokenizer.pre_tokenizer)
        self._characters = {b: c for c, b in byte_alphabet().items()}
        # Ids of known words as bytes; a full cache becomes the old one, from which used words return.
        self._known: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _words(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self._known.get, words))
        merge, old = self._tokenizer.model.tokenize, self._old
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = old.get(word)
                if ids is None:
                    ids = array("I", [t.id for t in merge(word.decode("latin-1").translate(self._characters))]).tobytes()
                found[i] = ids
                if len(word) <= 64:
                    self._known[word] = ids
        if len(self._known) > 250_000:
            self._known, self._old = {}, self._known
        return found

    def of(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        for a, b in portions(texts, 2_000_000):
            buf, starts, lens, numbers = self._cutter.words(texts[a:b])
            if len(starts):
                firsts, which = distinct(buf, starts, lens)
                data = buf.tobytes()
                s = starts[firsts]
                each = self._words([data[i:j] for i, j in zip(s.tolist(), (s + lens[firsts]).tolist(), strict=True)])
                sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
                flat = np.frombuffer(b"".join(each), dtype=np.uint32)
                begin = np.cumsum(sizes) - sizes
                ids = flat[ragged(begin[which], sizes[which])]
                bounds = np.concatenate([[0], np.cumsum(sizes[which])])[numbers]
            else:
                ids, bounds = np.zeros(0, dtype=np.uint32), np.zeros(b - a + 1, dtype=np.int64)
            for i, text in enumerate(texts[a:b]):
                if any(s in text for s in self._special):
                    found = self._tokenizer.encode(text, add_special_tokens=False).ids
                    out.append(np.array(found, dtype=np.uint32))
                else:
                    out.append(ids[bounds[i] : bounds[i + 1]])
        return out


class Piece:
    """A run of one document's tokens."""

    __slots__ = ("doc", "start", "ids", "total", "plain")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int, plain: int):
        self.doc, self.start, self.ids, self.total, self.plain = doc, start, ids, total, plain

    def loss(self, length: int) -> int:
        """Of its first ``length`` tokens, those that bear loss: neither its first nor of the prompt."""
        return max(0, length - max(1, self.plain - self.start))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        a = Piece(self.doc, self.start, self.ids[:length], self.total, self.plain)
        return a, Piece(self.doc, self.start + length, self.ids[length:], self.total, self.plain)


class Packer:
    """Places pieces into open sequences; full sequences are handed on as they close.

    A piece goes whole to the open sequence in which it fits and whose free room, as a vector of
    tokens, segments and loss tokens relative to their limits, has the largest dot product with the
    piece's needs. Where it fits in none, a new sequence opens; with ``width`` of them open, the piece
    is cut so that it fills the one of the largest dot product.
    """

    def __init__(self, tokens: int, segments: int, loss: int, width: int):
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self._tokens, self._segments, self._loss = tokens, segments, loss
        self._free = np.tile(self.limits, (width, 1))
        self._open: list[list[Piece]] = []
        self._width = width

    def _needs(self, piece: Piece) -> np.ndarray:
        n = len(piece.ids)
        return np.array([n, 1, piece.loss(n)], dtype=np.float64)

    def _fitting(self, piece: Piece, free: Sequence[float]) -> int:
        """The longest beginning of a piece that fits into the free room."""
        n = int(min(len(piece.ids), free[0]))
        if free[1] < 1:
            return 0
        return max(0, n - max(0, piece.loss(n) - int(free[2])))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids):
            n = len(piece.ids)
            if n >= self._tokens:
                head = self._fitting(piece, self.limits)
                first, piece = piece.cut(head)
                yield from self.close([first])
                continue
            needs = self._needs(piece)
            count = len(self._open)
            free = self._free[:count]
            score = (free / self.limits) @ (needs / self.limits)
            fits = np.flatnonzero((free >= needs).all(axis=1))
            if len(fits):
                at, length = int(fits[np.argmax(score[fits])]), n
            elif count < self._width:
                at = count
                self._open.append([])
                self._free[at] = self.limits
                length = self._fitting(piece, self.limits)
            else:
                at = int(np.argmax(score))
                length = self._fitting(piece, free[at])
            if length:
                first, piece = piece.cut(length)
                self._free[at] -= self._needs(first)
                self._open[at].append(first)
            if not length or self._free[at, 0] < 1 or self._free[at, 1] < 1 or self._free[at, 2] < 1:
                pieces = self._open[at]
                last = len(self._open) - 1
                self._open[at] = self._open[last]
                self._free[at] = self._free[last]
                self._open.pop()
                yield from self.close(pieces)

    def close(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """A sequence as it is if full; else its content in sequences whose sizes are powers of two, which need no padding."""
        left = sum(len(p.ids) for p in pieces)
        while left:
            size = self._tokens if left >= self._tokens else 1 << (left.bit_length() - 1)
            taken, room = [], size
            while room:
                head, rest = pieces[0].cut(min(room, len(pieces[0].ids)))
                taken.append(head)
                room -= len(head.ids)
                pieces = [rest, *pieces[1:]] if len(rest.ids) else pieces[1:]
            left -= size
            yield taken

    def finish(self) -> Iterator[list[Piece]]:
        """What is open at the end, laid end to end under the same limits."""
        rest = [p for pieces in self._open for p in pieces]
        self._open = []
        free, taken = self.limits.copy(), []
        for piece in rest:
            while len(piece.ids):
                n = self._fitting(piece, free)
                if not n:
                    yield from self.close(taken)
                    free, taken = self.limits.copy(), []
                    continue
                head, piece = piece.cut(n)
                free -= self._needs(head)
                taken.append(head)
        yield from self.close(taken)


_IDS: dict[str, TokenIds] = {}
_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    end_id: int = 0,
    tokens: int = 1024,
    segments: int = 128,
    loss: int = 1024,
    width: int = 32,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids on request.

    A document is its token ids and ``end_id``. Sequences hold at most ``tokens`` tokens, ``segments``
    pieces and ``loss`` loss-bearing tokens: those of a piece but its first and but the document's
    first ``prompt`` tokens (a column; null or absent: none). Cutting a document makes room in
    full sequences, and what a task has left at its end, like any sequence that another limit
    closes, goes into sequences of power-of-two sizes, so nothing is padded.

    Each task packs the rows it reads, with at most ``width`` sequences open, so nothing is
    shuffled and memory holds one batch of texts. Sequence numbers hold the task's number; a task
    that runs again gives the same rows. A null text is empty: its only token is ``end_id``. Rows that
    repeat an id are packed each. Other columns are not read. An empty table gives no rows.
    """
    if min(tokens, segments, loss) < 1 or tokens & (tokens - 1):
        raise ValueError("limits start at 1, and the limit on tokens is a power of two")
    columns = [F.col(doc_id).alias("doc_id"), text_of(text).alias("t")]
    columns.append((F.coalesce(F.col(prompt), F.lit(0)) if prompt else F.lit(0)).cast("long").alias("plain"))
    fields = docs.select(*columns)
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, {_FIELDS}" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _IDS:
            _IDS[path] = TokenIds(path)
        packer = Packer(tokens, segments, loss, width)
        number = TaskContext.get().partitionId() << 40
        kind = None

        def rows(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    raw = np.ascontiguousarray(p.ids, dtype="<u4")
                    row = (p.doc, p.start, len(raw), zlib.crc32(raw), p.total, number, offset)
                    yield (*row, raw.tolist()) if with_ids else row
                    offset += len(raw)
                number += 1

        def packed(found: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            kinds = [kind, *[pa.int64()] * 6]
            if with_ids:
                names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int64())]
            values = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found: list[tuple] = []
                for doc, ids, plain in zip(
                    part.column("doc_id").to_pylist(),
                    _IDS[path].of(part.column("t").to_pylist()),
                    part.column("plain").to_pylist(),
                    strict=True,
                ):
                    whole = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                    found += rows(packer.add(Piece(doc, 0, whole, len(whole), plain)))
                if found:
                    yield packed(found)
        if found := list(rows(packer.finish())):
            yield packed(found)

    return fields.mapInArrow(run, schema)
