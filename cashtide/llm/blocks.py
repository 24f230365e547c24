"""Words of many texts at once, as arrays: what the token, shingle and tagging operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Bytes of a word that are read as numbers; longer words are hashed one by one.
_WIDE = 32


def portions(texts: Sequence[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` characters together; a longer text is a range of its own."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def loaded(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, columns: int) -> list[np.ndarray]:
    """The first 8 x ``columns`` bytes of each word as little-endian numbers, zero beyond its end.

    ``buf`` must go on for 8 x (columns + 1) bytes behind the last word.
    """
    eight = buf[: buf.size // 8 * 8].view("<u8")
    shift = ((starts & 7) << 3).astype(np.uint64)
    at = starts >> 3
    out = []
    for c in range(columns):
        whole = (eight[at + c] >> shift) | ((eight[at + c + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        out.append(whole & _MASKS[np.clip(lens - 8 * c, 0, 8)])
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    h = lens.astype(np.uint64)
    for odd, column in zip(_ODD, loaded(buf, starts, lens, _WIDE // 8), strict=True):
        h = mix(h * odd + column)
    for i in np.flatnonzero(lens > _WIDE):
        word = buf[starts[i] : starts[i] + lens[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return h


def distinct(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct word, and for each word the number of its distinct one.

    Words are told apart by their bytes: those that share a hash are compared.
    """
    h = hashes(buf, starts, lens)
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(h), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    firsts = order[new]
    same = lens == lens[firsts][which]
    narrow = np.flatnonzero(lens <= 16)
    columns = loaded(buf, starts[narrow], lens[narrow], 2)
    heads = loaded(buf, starts[firsts], np.minimum(lens[firsts], 16), 2)
    for c, d in zip(columns, heads, strict=True):
        same[narrow] &= c == d[which[narrow]]
    for i in np.flatnonzero(lens > 16):
        f = firsts[which[i]]
        same[i] &= i == f or buf[starts[i] : starts[i] + lens[i]].tobytes() == buf[starts[f] : starts[f] + lens[f]].tobytes()
    if not same.all():  # two words with one hash: the others get numbers of their own
        extra: dict[bytes, int] = {}
        added = []
        for i in np.flatnonzero(~same):
            word = buf[starts[i] : starts[i] + lens[i]].tobytes()
            if word not in extra:
                extra[word] = len(firsts) + len(added)
                added.append(i)
            which[i] = extra[word]
        firsts = np.concatenate([firsts, np.array(added, dtype=firsts.dtype)])
    return firsts, which


def padded(data: bytes) -> np.ndarray:
    """Bytes with room behind them for ``loaded``."""
    return np.frombuffer(data + bytes(_WIDE + 16), dtype=np.uint8)


def blank_words(texts: Sequence[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between blanks and the controls 9 to 13: bytes, starts, lengths, and for each text its first word's number.

    With ``fold``, A to Z are lower-cased in the bytes. The last array has one entry more than texts.
    """
    parts = [t.encode() for t in texts]
    buf = padded(b"\n".join([*parts, b""]) if parts else b"")
    size = sum(map(len, parts)) + len(parts)
    if fold:
        buf = _FOLD[buf]
    body = buf[:size]
    word = ~((body == 32) | ((body >= 9) & (body <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return buf, starts, ends - starts, np.searchsorted(starts, bounds)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
