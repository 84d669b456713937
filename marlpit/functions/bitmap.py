"""Bits of a set of 64-bit keys: a Bloom filter of bounded size that tasks share to skip what nobody asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARSE = 16  # bits per key
PARTS = (0, 18, 36)  # the keys are hashes already; their bits from here on are the places of a key: 0.5 percent pass wrongly
LEAST, MOST = 20, 28  # powers of two: 128 KB up to 32 MB, however many keys there are


class KeyBits:
    """Whether keys may be in the set. A key of the set is always reported; others are too when the bits are crowded."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for p in PARTS:
            k = (keys[left] >> np.uint64(p)) & self.mask
            left = left[((self.words[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1)).astype(bool)]
        out[left] = True
        return out


def key_bits(keys: DataFrame, sparse: int = SPARSE) -> np.ndarray:
    """The words of :class:`KeyBits` for the column ``key``: made inside the engine, at most ``2 ** MOST`` bits reach the driver."""
    total = keys.count()
    power = min(MOST, max(LEAST, int(np.ceil(np.log2(max(1, sparse * total))))))
    places = keys.select(F.explode(F.array(*[F.expr(f"shiftrightunsigned(key, {p}) & {(1 << power) - 1}L") for p in PARTS])).alias("low"))
    words = places.groupBy(F.expr("shiftright(low, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(low & 63L as int)))").alias("bits"))
    out = np.zeros(1 << (power - 6), dtype=np.uint64)
    got: pa.Table = words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out
