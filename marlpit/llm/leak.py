"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, verified on shingles."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.bitmap import KeyBits, key_bits
from marlpit.functions.fold import words
from marlpit.functions.shingles import MinHasher, WordHash, line_ngrams, mix, ngrams
from marlpit.session import cut, spread

RUN = 20  # successive words that make a leak
ALTERED = 7  # at most one altered word in seven ("about one in eight")
GRAM = 3  # an altered word in eight leaves too few longer shingles whole
PART = 48  # words of a document part; longer documents are cut into overlapping parts
SIZES = (12, 18, 26, 46)  # upper shingle counts of the partitions of document parts
OVERLAP = 20
SHARED = RUN - GRAM + 1 - GRAM * (RUN // ALTERED + 1)  # shingles that a passage with the most altered words still shares
FEW_WORDS = 1 << 22  # items of up to so many words together are checked from memory, larger sets by a join
MISS = 1e-4  # chance that the search misses a shortest, most altered passage
_LINES = re.compile(r"(?<=[.!?…])\s+|\n+")


def own_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): folded words of each item without the lines that several items share."""

    def lines(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, w) for k, t in zip(b["k"], b["t"]) for i, w in enumerate(words(x) for x in _LINES.split(t or "")) if w]
            yield pd.DataFrame(rows, columns=["k", "i", "w"])

    kind = items.schema[key].dataType.simpleString()
    each = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null").distinct().mapInPandas(lines, f"k {kind}, i int, w array<string>")
    owners = each.groupBy("w").agg(F.countDistinct("k").alias("n")).filter("n = 1").select("w")
    return each.join(owners, "w", "left_semi").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("x")).select("k", F.flatten("x.w").alias("words"))


HITS = 4  # bands in which an item window and a document part meet at least; unrelated texts of one style meet in fewer
Q = RUN - GRAM + 1  # shingles of a query window
KEPT = max(1, SHARED)
SPAN = Q + 2  # shingles of the shortest passage with two words put in


def bands_for(similarity: float) -> int:
    """One-row bands that leave at most the chance ``MISS`` of fewer than ``HITS`` meetings at this Jaccard similarity."""
    n = HITS
    while sum(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(HITS)) > MISS:
        n += 1
    return n


#: Bands of each partition, for the containment KEPT / Q in a set of the partition's upper size.
BANDS = tuple(bands_for(KEPT / (Q + s - KEPT)) for s in SIZES)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    """Keys that tell the bands apart, for bands x sets minima."""
    with np.errstate(over="ignore"):
        return mix(minima ^ (np.arange(1, len(minima) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])


class Windows:
    """Band keys of every window of ``RUN`` successive own words of an item."""

    def __init__(self) -> None:
        self.hash, self.hasher = WordHash(), MinHasher(max(BANDS))

    def __call__(self, own: list[str]) -> np.ndarray:
        g = ngrams(self.hash(own), GRAM)
        at = np.arange(len(g) - Q + 1)
        sets = g[at[:, None] + np.arange(Q)].ravel()
        return np.unique(_band_keys(self.hasher.minima(sets, at * Q)))


class Parts:
    """Band keys of document parts, for those parts that can hold a window of an asked item.

    Of a part only the shingles that some item has stand in its set. The sets are partitioned by size; in each partition the
    containment that a leaked window must reach is turned into the Jaccard similarity it has with a set of the partition's
    upper size, and the number of bands follows from that, ``HITS`` and ``MISS``. Small sets thus need few hash orders. A
    part where no stretch as long as a passage has as many shingles of any items as a leak is passed over. The bits that tell
    the items' shingles can only let more through.
    """

    def __init__(self, grams: KeyBits, keys: KeyBits) -> None:
        self.grams, self.keys = grams, keys
        self.hash, self.hasher = WordHash(), MinHasher(max(BANDS))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of the parts' keys that some item window has."""
        flat: list[str] = []
        lengths = []
        for t in texts:
            w = words(t)
            lengths.append(len(w))
            flat += w
        n = np.array(lengths, dtype=np.int64)
        out: list[np.ndarray] = []
        if (n >= GRAM).any():
            g, _ = line_ngrams(self.hash(flat), n[n > 0], GRAM)
            hit = self.grams.has(g)
            hits = np.concatenate([[0], np.cumsum(hit)])
            dense = np.concatenate([[0], np.cumsum(hits[np.minimum(np.arange(len(g)) + SPAN, len(g))] - hits[:-1] >= KEPT)])
            size = np.where(n == 0, 0, np.maximum(n - GRAM + 1, 1))
            first = np.concatenate([[0], np.cumsum(size)])
            sets: list[list[tuple[int, np.ndarray]]] = [[] for _ in SIZES]
            for d in np.flatnonzero((n >= GRAM) & (dense[first[1:]] > dense[first[:-1]])).tolist():
                for o in range(0, max(1, lengths[d] - OVERLAP), PART - OVERLAP):
                    a, z = first[d] + o, first[d] + min(o + PART - GRAM + 1, size[d])
                    if dense[z] > dense[a]:
                        s = np.unique(g[a:z][hit[a:z]])
                        if len(s) >= KEPT:
                            sets[int(np.searchsorted(SIZES, len(s)))].append((d, s))
            for p, found in enumerate(sets):
                if found:
                    starts = np.cumsum([0, *(len(s) for _, s in found)])[:-1]
                    keys = _band_keys(self.hasher.minima(np.concatenate([s for _, s in found]), starts)[: BANDS[p]])
                    known = np.flatnonzero(self.keys.has(keys.ravel()))
                    owner = np.array([d for d, _ in found], dtype=np.uint64)[known % len(found)]
                    out.append(np.stack([owner, keys.ravel()[known]]))
        text, key = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), dtype=np.uint64)
        return text.astype(np.int64), key


class Item:
    """An item for the exact check of a document."""

    def __init__(self, hashed: np.ndarray) -> None:
        self.hashed = hashed
        grams = ngrams(hashed, GRAM)
        self.grams = np.unique(grams)
        self.where: dict[int, list[int]] = defaultdict(list)
        for p, g in enumerate(grams.tolist()):
            self.where[g].append(p)

    def held_by(self, doc: np.ndarray, grams: np.ndarray) -> bool:
        """Whether the document, with its shingles in order, has a long enough run of the item's words along a diagonal."""
        diagonals: Counter[int] = Counter()
        for k, g in enumerate(grams.tolist()):
            for p in self.where.get(g, ()):
                diagonals[k - p] += 1
        item, n = self.hashed, len(self.hashed)
        for d in diagonals:
            same = np.zeros(n, dtype=bool)
            for s in (-2, -1, 0, 1, 2):  # a word or two may be dropped or inserted
                if diagonals.get(d + s):
                    p0, p1 = max(0, -(d + s)), min(n, len(doc) - d - s)
                    if p1 > p0:
                        same[p0:p1] |= item[p0:p1] == doc[p0 + d + s : p1 + d + s]
            if same.sum() >= RUN - RUN // ALTERED and _run(same):
                return True
        return False


class Items:
    """Some items with the places of their shingles, for the exact check of documents."""

    def __init__(self, items: list[tuple[object, list[str]]]) -> None:
        self.hash = WordHash()
        self.at = {k: n for n, (k, _) in enumerate(items)}
        self.keys, self.items = [k for k, _ in items], [Item(self.hash(w)) for _, w in items]
        grams = [i.grams for i in self.items]
        flat = np.concatenate([*grams, np.empty(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.gram, first = np.unique(flat[order], return_index=True)
        self.first, self.owner = np.append(first, len(flat)), np.repeat(np.arange(len(items)), [len(g) for g in grams])[order]

    def held_by(self, text: str, asked: Iterable) -> Iterator:
        """Those of the asked items that the text holds."""
        doc = self.hash(words(text))
        grams = ngrams(doc, GRAM)
        known = np.unique(grams)
        at = np.minimum(np.searchsorted(self.gram, known), max(0, len(self.gram) - 1))
        at = at[self.gram[at] == known] if len(self.gram) else at[:0]
        n = self.first[at + 1] - self.first[at]
        take = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[take], minlength=len(self.items))
        for i in asked:
            if shared[self.at[i]] >= KEPT and self.items[self.at[i]].held_by(doc, grams):
                yield i


def _run(same: np.ndarray) -> bool:
    """Whether some stretch of ``RUN`` words or more begins and ends with a kept word and has at most one altered in ``ALTERED``."""
    score = ALTERED * np.concatenate([[0], np.cumsum(same)]) - (ALTERED - 1) * np.arange(len(same) + 1)
    opens = np.where(same, score[:-1], np.iinfo(np.int64).max)
    least = np.minimum.accumulate(opens)[: max(0, len(same) - RUN + 1)]
    closes = same[RUN - 1 :]
    return bool((closes & (score[RUN:] >= least)).any()) if len(least) else False


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_id, test_id): documents that hold at least ``RUN`` successive own words of an item, one in ``ALTERED`` altered.

    Item windows become min-hash band keys, partitioned by key. One scan of the documents gives the band keys of their
    parts, filtered by the bits of the item side (bounded, see :mod:`marlpit.functions.bitmap`), and only keys that an
    item may have are shuffled; so the corpus is read once, however many items there are, and nothing is collected. A
    join on the keys gives candidate pairs, those that meet in ``HITS`` bands, which the exact shingle count and alignment verify. A key that very many
    documents share has few rows on the item side; the adaptive join splits it.

    Defined results: letter case, punctuation, spacing, markup entities, character forms, look-alikes and invisible
    characters do not matter; lines (sentences) that several items share do not count; null and short texts hold
    nothing and leak nothing; repeated rows give one row; very long documents are searched whole, in overlapping parts.
    """
    own = cut(own_words(items, item_key, item_text).filter(F.size("words") >= RUN), "leak")
    doc_kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()

    def window_keys(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Windows()
        for b in batches:
            for k, w in zip(b["k"], b["words"]):
                yield pd.DataFrame({"key": one(list(w)).view(np.int64), "item": k})

    def grams(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            yield pd.DataFrame({"key": np.concatenate([ngrams(hashed(list(w)), GRAM) for w in b["words"]] or [np.empty(0, dtype=np.uint64)]).view(np.int64)})

    asked = cut(spread(own, "k").mapInPandas(window_keys, f"key bigint, item {item_kind}"), "leak")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((key_bits(own.mapInPandas(grams, "key bigint")), key_bits(asked)))

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = Parts(*map(KeyBits, shared.value))
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                text, key = parts(part["t"].tolist())
                yield pd.DataFrame({"k": part["k"].to_numpy()[text], "key": key.view(np.int64)})

    rows = docs.select(F.col(doc_key).alias("k"), F.col(doc_text).alias("t")).filter("k is not null and t is not null")
    hits = spread(rows, "k").mapInPandas(scan, f"k {doc_kind}, key bigint")
    met = hits.join(asked, "key").groupBy("k", "item").agg(F.count("*").alias("n")).filter(F.col("n") >= HITS)
    pairs = cut(met.select("k", "item"), "leak")
    result = f"doc_id {doc_kind}, test_id {item_kind}"
    if (own.agg(F.sum(F.size("words"))).first()[0] or 0) <= FEW_WORDS:
        few = spark.sparkContext.broadcast([(r["k"], list(r["words"])) for r in own.toLocalIterator()])  # at most FEW_WORDS words

        def verify_all(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items = Items(few.value)
            for b in batches:
                yield pd.DataFrame([(k, i) for k, t, asked in zip(b["k"], b["t"], b["items"]) for i in items.held_by(t, asked)], columns=["doc_id", "test_id"])

        each = pairs.groupBy("k").agg(F.collect_list("item").alias("items"))  # no more than there are items
        return rows.join(each, "k").mapInPandas(verify_all, result).distinct()

    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = Items(list({i: (i, list(w)) for i, w in zip(b["item"], b["words"])}.values()))
            asked = b.groupby(["k", "t"], sort=False)["item"].agg(list)
            yield pd.DataFrame([(k, i) for (k, t), mine in asked.items() for i in items.held_by(t, mine)], columns=["doc_id", "test_id"])

    text = rows.join(pairs.select("k").distinct(), "k", "left_semi").distinct()
    both = pairs.join(text, "k").join(own.withColumnRenamed("k", "item"), "item").select("k", "t", "item", "words")
    return both.mapInPandas(verify, result).distinct()


def leak_counts(found: DataFrame, items: DataFrame, item_key: str, split: str) -> DataFrame:
    """(test_id, split, n_docs) of every item: the number of documents that hold it, 0 where none does."""
    n = found.groupBy("test_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    base = items.select(F.col(item_key).alias("test_id"), F.col(split).alias("split")).filter("test_id is not null").distinct()
    return base.join(n, "test_id", "left").select("test_id", "split", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))
