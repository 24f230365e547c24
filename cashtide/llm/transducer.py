"""Token counts by finite-state transducers: one cuts text into words, one counts a word's tokens.

Both are deterministic. The first has few states; chunks of text are turned into maps of its states,
which a parallel prefix scan composes, so every chunk learns the state it starts in. The second
follows the merges of a byte-level tokenizer; its transitions carry the change of the number of
tokens, and its states are compiled when text first reaches them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.blocks import distinct, padded, portions
from cashtide.llm.common import text_of

# Symbols of the cutting transducer: a character's class, with what lookahead there is to it.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, JOINING, CLOSING, END, PAD = range(10)
# Its states: what is open before the next character.
NOTHING, LETTERS, NUMBERS, OTHERS, BLANK, SPACE, ONE_MORE, TWO_MORE = range(8)
_STATES, _SYMBOLS = 8, 10
_UNKNOWN = 255


def _cutting() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a word begins at the character read, by state and symbol."""
    go = np.zeros((_STATES, _SYMBOLS), dtype=np.int64)
    begins = np.ones((_STATES, _SYMBOLS), dtype=bool)
    for s in range(_STATES):
        for symbol, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            go[s, symbol], begins[s, symbol] = run, s not in (run, BLANK)
        # An apostrophe that a short ending follows: part of a run of others, else 's or 'll.
        for symbol, after in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            inside = s in (OTHERS, BLANK)
            go[s, symbol], begins[s, symbol] = (OTHERS if inside else after), not inside
        go[s, INNER], begins[s, INNER] = SPACE, s != SPACE  # white space before white space or the end
        go[s, JOINING] = BLANK  # a blank that opens the next word
        go[s, CLOSING] = NOTHING  # other white space before a word
        go[s, END], begins[s, END] = NOTHING, False
        go[s, PAD], begins[s, PAD] = s, False
    for state, left in ((ONE_MORE, NOTHING), (TWO_MORE, ONE_MORE)):
        go[state, LETTER], begins[state, LETTER] = left, False
    return go, begins


class Cutter:
    """Cuts texts into the words that a byte-level tokenizer merges within."""

    def __init__(self, pre_tokenizer, chunk: int = 256):
        self._pre, self._chunk = pre_tokenizer, chunk
        self._classes = np.full(0x110000, _UNKNOWN, dtype=np.uint8)
        go, begins = _cutting()
        self._go, self._begins = go.ravel(), begins.ravel()
        # All maps of states that texts can produce, by number, with their products.
        maps = {tuple(range(_STATES)): 0}
        step: list[list[int]] = []
        queue = [tuple(range(_STATES))]
        for m in queue:
            row = []
            for symbol in range(_SYMBOLS):
                image = tuple(int(go[s, symbol]) for s in m)
                if image not in maps:
                    maps[image] = len(maps)
                    queue.append(image)
                row.append(maps[image])
            step.append(row)
        self._step = np.array(step, dtype=np.int64).ravel()
        self._product = np.array([[maps[tuple(b[s] for s in a)] for b in queue] for a in queue], dtype=np.int64)
        self._from_start = np.array([m[NOTHING] for m in queue], dtype=np.int64)

    def _class_of(self, character: str) -> int:
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self._pre.pre_tokenize_str(before + character)) == 1:
                return kind
        return JOINING if character == " " else CLOSING

    def _symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kinds = self._classes[points]
        if (kinds == _UNKNOWN).any():
            for p in np.unique(points[kinds == _UNKNOWN]).tolist():
                self._classes[p] = self._class_of(chr(p))
            kinds = self._classes[points]
        blank = kinds >= JOINING
        before_blank = np.append(blank[1:], True)
        symbols = np.where(blank & before_blank, np.uint8(INNER), kinds)
        quotes = np.flatnonzero(points == ord("'"))
        if len(quotes):
            after = np.concatenate([points, [0, 0]])
            one, two = after[quotes + 1], after[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            symbols[quotes] = np.where(short, SHORT, np.where(long, LONG, OTHER))
        symbols[ends] = END
        return symbols

    def words(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the texts, starts and lengths of their words, and for each text its first word's number."""
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        ends = bounds[1:] - 1
        symbols = self._symbols(points, ends)
        size = len(symbols)
        lanes = -(-size // self._chunk)
        grid = np.full(lanes * self._chunk, PAD, dtype=np.int64)
        grid[:size] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, self._chunk).T)
        # Each chunk's map of states, all chunks in step.
        maps = np.zeros(lanes, dtype=np.int64)
        for row in grid:
            maps = self._step[maps * _SYMBOLS + row]
        # Prefix scan: after round r every chunk's map covers the 2^r chunks up to it.
        reach = 1
        while reach < lanes:
            maps[reach:] = self._product[maps[:-reach], maps[reach:]]
            reach *= 2
        states = np.zeros(lanes, dtype=np.int64)
        states[1:] = self._from_start[maps[:-1]]
        flags = np.empty((self._chunk, lanes), dtype=bool)
        for i, row in enumerate(grid):
            at = states * _SYMBOLS + row
            flags[i] = self._begins[at]
            states = self._go[at]
        begins = flags.T.ravel()[:size].copy()
        marks = begins.copy()
        marks[ends] = True
        places = np.flatnonzero(marks)
        first = begins[places]
        starts, stops = places[first], np.append(places[1:], size)[first]
        numbers = np.searchsorted(starts, bounds)
        if len(points) and int(points.max()) >= 128:
            width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
            offset = np.concatenate([[0], np.cumsum(width)])
            starts, stops = offset[starts], offset[stops]
        return padded(joined.encode()), starts, stops - starts, numbers


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """A transducer over the bytes of a word whose outputs add up to its number of tokens.

    The tokens of a prefix end in exactly one token, and a token may follow another if merging the
    two gives the two again. A state is what the next bytes can still depend on: for each earlier
    position whose bytes up to here begin some token, the token before it and its count relative to
    here. Reading a byte lengthens these beginnings; the one that completes an allowed token gives
    the new last token, and its count the output, which can be negative. Equal states are one state.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]]):
        self._ranks = {pair: i for i, pair in enumerate(merges)}
        self._tokens: list[int] = [-1]  # by node of the trie
        self._next: dict[int, int] = {}
        self._inner = bytearray(1)
        self._bytes = {i: t for t, i in vocabulary.items()}
        for token, number in vocabulary.items():
            node = 0
            for b in token:
                self._inner[node] = 1
                key = node * 256 + b
                if key not in self._next:
                    self._next[key] = len(self._tokens)
                    self._tokens.append(-1)
                    self._inner.append(0)
                node = self._next[key]
            self._tokens[node] = number
        self._follows: dict[tuple[int, int], bool] = {}
        start = ((0, -1, 0),)
        self._numbers, self._states = {start: 0}, [start]
        self._edges: dict[int, tuple[int, int]] = {}

    def _merged(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self._ranks.get(p, len(self._ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self._ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, last: int, token: int) -> bool:
        known = self._follows.get((last, token))
        if known is None:
            b = self._bytes[token]
            a = self._bytes[last] if last >= 0 else b""
            known = self._merged(a + b) == ([a, b] if a else [b])
            self._follows[last, token] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        grown, last, change = [], None, 0
        for node, before, count in self._states[state]:
            child = self._next.get(node * 256 + byte)
            if child is None:
                continue
            token = self._tokens[child]
            if last is None and token >= 0 and self._may_follow(before, token):
                last, change = token, count + 1
            if self._inner[child]:
                grown.append((child, before, count))
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        image = (*((n, b, c - change) for n, b, c in grown), (0, last, 0))
        number = self._numbers.setdefault(image, len(self._states))
        if number == len(self._states):
            self._states.append(image)
        self._edges[state * 256 + byte] = (number, change)
        return number, change

    def count(self, word: bytes) -> int:
        """The number of tokens of a word."""
        if len(self._states) > 250_000:  # compiled states are only a cache
            self._numbers, self._states, self._edges = {self._states[0]: 0}, self._states[:1], {}
        edges, state, total = self._edges, 0, 0
        for byte in word:
            step = edges.get(state * 256 + byte)
            if step is None:
                step = self._compile(state, byte)
            state = step[0]
            total += step[1]
        return total


class TokenCounter:
    """Counts tokens of texts as the tokenizer of a byte-level vocabulary file gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        alphabet = byte_alphabet()
        self.special = [t["content"] for t in model["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        as_bytes = {t: bytes(alphabet[c] for c in t) for t in model["model"]["vocab"] if t not in self.special}
        self._counter = Counter(
            {b: model["model"]["vocab"][t] for t, b in as_bytes.items()}, [(as_bytes[a], as_bytes[b]) for a, b in merges]
        )
        self._cutter = Cutter(Tokenizer.from_file(path).pre_tokenizer)
        self._known: dict[bytes, int] = {}

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """Tokens per text. A special token's string in a text is that one token and parts the text."""
        pieces, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            parts = [t]
            for s in self.special:
                if s in t:
                    cut = [p.split(s) for p in parts]
                    extra[i] += sum(len(c) - 1 for c in cut)
                    parts = [q for c in cut for q in c]
            pieces += parts
            owner += [i] * len(parts)
        totals = np.zeros(len(pieces), dtype=np.int64)
        for a, b in portions(pieces):
            buf, starts, lens, numbers = self._cutter.words(pieces[a:b])
            if not len(starts):
                continue
            firsts, which = distinct(buf, starts, lens)
            data = buf.tobytes()
            each = np.array([self._word(data[s : s + n]) for s, n in zip(starts[firsts].tolist(), lens[firsts].tolist(), strict=True)])
            sums = np.concatenate([[0], np.cumsum(each[which])])
            totals[a:b] = sums[numbers[1:]] - sums[numbers[:-1]]
        np.add.at(extra, np.array(owner, dtype=np.int64), totals)
        return extra

    def _word(self, word: bytes) -> int:
        n = self._known.get(word)
        if n is None:
            if len(self._known) > 500_000:
                self._known.clear()
            n = self._counter.count(word)
            if len(word) <= 64:
                self._known[word] = n
        return n


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a byte-level vocabulary file that every executor has. A null text is empty and has
    no tokens; texts are read whole, in blocks of a few million characters, and a longer text is a
    block of its own. Rows that repeat an id are counted each. Other columns are not read; nothing
    is shuffled. An empty table gives no rows. An executor compiles its transducer once.
    """
    fields = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            n_bytes = pc.binary_length(batch.column("t")).cast(pa.int64())
            n_tokens = np.empty(batch.num_rows, dtype=np.int64)
            for a in range(0, batch.num_rows, 1000):
                texts = batch.column("t").slice(a, 1000).to_pylist()
                n_tokens[a : a + len(texts)] = counter.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(n_tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return fields.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
