"""BPE encoding and decoding: part boundaries and adjacent ranks in contiguous arrays."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.common import text_of
from cashtide.llm.transducer import byte_alphabet

_NONE = 1 << 30


class RankArray:
    """Merges the symbols of a word by rank, given a table of ranks and one of results by pair of ids."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self._ranks = ranks

    def merge(self, parts: list[int]) -> list[int]:
        """Ids of a word's symbols after all merges. Words of many symbols go by a heap to the same result."""
        return self._short(parts) if len(parts) <= 96 else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        """Scan the ranks for the least, drop the boundary there, refresh the ranks beside it."""
        known = self._ranks
        ranks = [known.get(p, (_NONE, 0))[0] for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = known[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = known.get((parts[i - 1], parts[i]), (_NONE, 0))[0]
            if i < len(ranks):
                ranks[i] = known.get((parts[i], parts[i + 1]), (_NONE, 0))[0]
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        known, n = self._ranks, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(known[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in known]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = known[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := (parts[left], parts[right])) in known:
                    heapq.heappush(heap, (known[pair][0], left, *pair))
        return [p for p in parts if p >= 0]


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a word-end vocabulary file: lower case, white space dropped."""

    # Outside these, normal forms and classes of characters are left to the library's own tables.
    _USUAL = regex.compile(r"[^\x00-ɏ]")
    _PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xA0\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, vocabulary = file["model"], file["model"]["vocab"]
        self._special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("special tokens must be found in texts as they are")
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))) + ")")
        self._end = model["end_of_word_suffix"] or ""
        self._ids, self._alphabet = vocabulary, {b: c for c, b in byte_alphabet().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._merges = RankArray({(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(merges)})
        self._tokens = {i: t for t, i in (vocabulary | self._special).items()}
        self._known: dict[str, list[int]] = {}

    def _normal(self, text: str) -> list[str]:
        """Pieces of a text without special tokens, in the byte alphabet."""
        if self._USUAL.search(text):
            normal = self._tokenizer.normalizer.normalize_str(text)
            return [p for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return self._PIECE.findall(text.lower())

    def _word(self, piece: str, mapped: bool) -> list[int]:
        key = f"\0{piece}" if mapped else piece
        ids = self._known.get(key)
        if ids is None:
            if len(self._known) > 400_000:
                self._known.clear()
            symbols = list(piece if mapped else piece.encode().decode("latin-1").translate(self._alphabet))
            symbols[-1] += self._end
            ids = self._merges.merge([self._ids[s] for s in symbols])
            if len(piece) <= 64:
                self._known[key] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._cut.split(text):
            if part in self._special:
                out.append(self._special[part])
                continue
            mapped = self._USUAL.search(part) is not None
            known = self._known
            pieces = self._normal(part)
            if mapped:
                out += chain.from_iterable([self._word(p, True) for p in pieces])
            else:
                out += chain.from_iterable([known.get(p) or self._word(p, False) for p in pieces])
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens with a blank between, as a vocabulary file without a decoder gives them."""
        return " ".join([self._tokens[i] for i in ids])


_CODERS: dict[str, WordBpe] = {}


def _coder(path: str) -> WordBpe:
    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and its ids.

    A null text is empty and has no ids; texts are encoded whole. Rows that repeat an id are encoded
    each. Other columns are not read; nothing is shuffled. An empty table gives no rows.
    """
    fields = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = pa.array([coder.encode(t.as_py()) for t in part.column("t")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return fields.mapInArrow(run, f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: doc_id, decoded. Null ids give the empty text; an unknown id is an error."""
    fields = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            texts = pa.array([coder.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "decoded"])

    return fields.mapInArrow(run, f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, decoded string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes each text and decodes its ids again in one pass, so that neither crosses to the JVM.
    Hashes are of the decimal ids with a blank between, and of the decoded text. Else as ``encode``.
    """
    fields = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            counts, first, second = [], [], []
            for t in batch.column("t"):
                ids = coder.encode(t.as_py())
                counts.append(len(ids))
                first.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return fields.mapInArrow(run, schema)
