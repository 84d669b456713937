"""Hashes of words and word n-grams in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from marlpit.functions.memo import Memo

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHash:
    """64-bit hash of a word; the table of known words is emptied when it is full, so it stays bounded."""

    def __init__(self, room: int = 300_000) -> None:
        self.known = Memo(room)

    def __call__(self, words: list[str]) -> np.ndarray:
        self.known.trim()
        known = self.known
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def line_ngrams(word_hashes: np.ndarray, lengths: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word positions) of the n-grams inside consecutive lines of the given lengths; a shorter line is one n-gram.

    The hashes equal those of the n-grams of every line taken alone; all lines are done in one pass.
    """
    size = np.asarray(lengths, dtype=np.int64)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(word_hashes))
    h = np.repeat(np.minimum(size, n).astype(np.uint64), size)
    padded = np.append(word_hashes, np.zeros(n, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for k in range(n):
            step = (h ^ padded[k : k + len(at)]) * _MUL
            step ^= step >> np.uint64(29)
            h = np.where(at + k < ends, step, h)
        first = ends - np.repeat(size, size) == at
        keep = (at + n <= ends) | (first & (np.repeat(size, size) < n))
        return mix(h[keep]), at[keep]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def ngrams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence; the whole sequence when it is shorter, nothing when it is empty."""
    n = min(n, len(word_hashes))
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    size = len(word_hashes) - n + 1
    h = np.full(size, np.uint64(n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ word_hashes[k : k + size]) * _MUL
            h ^= h >> np.uint64(29)
        return mix(h)


class MinHasher:
    """``bands`` independent multiply-add hash orders; a value is the minimum of a set under one of them."""

    def __init__(self, bands: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.bands = bands

    def minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """bands x sets: minima of the consecutive, non-empty sets that begin at ``starts``."""
        out = np.empty((self.bands, len(starts)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.bands):
                v = hashes * self.a[k] + self.b[k]
                v ^= v >> np.uint64(32)
                out[k] = np.minimum.reduceat(v, starts)
        return out
