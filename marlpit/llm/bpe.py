"""Encoding with a public byte-level BPE vocabulary: merges driven by a segment tree over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.session import spread

#: Fixed value: the pattern that splits a text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one ``base64 rank`` pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Text to ids. Pieces up to ``keep`` bytes are remembered, at most ``room`` of them, as the same words recur."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 48, room: int = 200_000) -> None:
        self.ranks, self.keep, self.room = ranks, keep, room
        self.split = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give no ids."""
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for piece in self.split.findall(text):
            got = known.get(piece)
            if got is None:
                raw = piece.encode("utf-8")
                one = self.ranks.get(raw)
                got = [one] if one is not None else self.merge(raw)
                if len(raw) <= self.keep:
                    if len(known) >= self.room:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Merge the lowest-ranked neighbouring pair, the leftmost of equals, until none is left.

        Leaf ``i`` of the segment tree holds the rank of the pair that starts at live position ``i``; inner nodes hold
        the minimum, and descending to the left child on ties finds its leftmost leaf. A merge changes at most three
        leaves (the merged one, the one swallowed, the left neighbour), each in O(log n), so a piece of n bytes takes
        O(n log n), where rescanning all pairs after each merge would take O(n * n).
        """
        n, ranks = len(raw), self.ranks
        if n == 1:
            return [ranks[raw]]
        size = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(raw[i : i + 2], NONE)
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours; n and -1: none
        end = list(range(1, n + 1))  # where the token that starts here ends

        def put(i: int, rank: int) -> None:
            i += size
            if tree[i] == rank:
                return
            tree[i] = rank
            i >>= 1
            while i:
                left, right = tree[2 * i], tree[2 * i + 1]
                least = left if left <= right else right
                if tree[i] == least:
                    return
                tree[i] = least
                i >>= 1

        while tree[1] != NONE:
            at = 1
            while at < size:
                at *= 2
                if tree[at] > tree[at + 1]:
                    at += 1
            i = at - size
            j = nxt[i]
            end[i], nxt[i] = end[j], nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            put(j, NONE)
            k = nxt[i]
            put(i, ranks.get(raw[i : end[k]], NONE) if k < n else NONE)
            p = prev[i]
            if p >= 0:
                put(p, ranks.get(raw[p : end[i]], NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = nxt[i]
        return out


def encode_table(df: DataFrame, key: str, text: str, ranks_path: str) -> DataFrame:
    """(key, ids) of every row of ``df``: ids of ``text`` by the byte-level BPE of ``ranks_path``, as bigint array.

    The ranks (a vocabulary file of fixed size, under 1 MB) are read on the driver and broadcast. Defined results: null
    and empty texts give an empty array; texts of any length are encoded whole; strings of special tokens are ordinary
    text; repeated rows are kept; an empty table gives no rows; further columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "ids": [encoder.encode(t) for t in b["t"]]})

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"k {kind}, ids array<bigint>").select(F.col("k").alias(key), "ids")
