"""Distinct word shingles of texts, and their min-max signatures, as arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

from cashtide.llm.blocks import blank_words, hashes, mix, portions

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: Sequence[str], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``words`` words, A to Z folded.

    Words are what stands between blanks and the controls 9 to 13. A text with fewer words is one
    shingle, one without any has none.
    """
    for a, b in portions(texts):
        buf, starts, lens, numbers = blank_words(texts[a:b])
        h = hashes(buf, starts, lens) if len(starts) else np.zeros(0, dtype=np.uint64)
        joined = h.copy()
        for j in range(1, words):
            n = max(0, len(h) - j)
            joined[:n] = mix(joined[:n] * _STEP + h[j:])
        for first, last in zip(numbers[:-1].tolist(), numbers[1:].tolist(), strict=True):
            if last - first >= words:
                yield np.unique(joined[first : last - words + 1])
            elif last > first:
                short = np.array([last - first], dtype=np.uint64)
                for x in h[first:last]:
                    short = mix(short * _STEP + x)
                yield short
            else:
                yield np.zeros(0, dtype=np.uint64)


class MinMax:
    """Band keys from the least and the greatest hash of a set under each of some permutations.

    Multiplying by an odd number permutes the 64-bit hashes. One product per permutation and shingle
    gives two signature values, its minimum and its maximum, each equal for two sets with the
    probability of their similarity; minima and maxima stand in bands of their own, so that the
    values of one band are of different permutations.
    """

    def __init__(self, rows: int = 6, bands: int = 40, seed: int = 7):
        if bands % 2:
            raise ValueError("half of the bands are of minima, half of maxima")
        self.rows, self.bands = rows, bands
        draw = np.random.default_rng(seed)
        self._factors = draw.integers(1, 1 << 63, size=rows * bands // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._salts = draw.integers(0, 1 << 63, size=bands, dtype=np.uint64)

    def keys(self, sets: Sequence[np.ndarray]) -> np.ndarray:
        """One row of band keys per set; none of the sets may be empty."""
        flat = np.concatenate(sets)
        heads = np.cumsum([0, *(len(s) for s in sets)])[:-1]
        half = self.bands // 2
        out = np.empty((len(sets), self.bands), dtype=np.uint64)
        for band in range(half):
            low = np.full(len(sets), self._salts[band])
            high = np.full(len(sets), self._salts[band + half])
            for factor in self._factors[band * self.rows : (band + 1) * self.rows]:
                image = flat * factor
                low = mix(low * _STEP + np.minimum.reduceat(image, heads))
                high = mix(high * _STEP + np.maximum.reduceat(image, heads))
            out[:, band], out[:, band + half] = low, high
        return out


def set_digest(shingles: np.ndarray) -> bytes:
    """A name for a set: equal for equal sets."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
