"""Same or near-same records across splits: a prefix filter over word phrases that misses no pair, containment of each pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.fold import words
from marlpit.functions.ids import canonical_user
from marlpit.functions.memo import Memo
from marlpit.functions.shingles import WordHash, line_ngrams
from marlpit.session import cut, spread

PHRASE = 3  # words of the shortest phrase that counts as returned when a pair is measured
SHARE = 0.9  # share of the words of one record that returns in the other
NEED = 32  # words, besides those that a match may lack, that a record asks for; more give fewer candidates and lose none
LEAD = 8  # the same for the words that are looked up first; only who has so many of them is held against all that are asked
CELLS = 1 << 20  # cells of the phrase counts, whatever the size of the input; they only steer which words are asked for
BLOCK = 1 << 16  # classes whose questions are broadcast together
TEXTS = 32  # bodies that are held against a block together


def lines_of(text: str | None) -> list[list[str]]:
    """Folded words by line; lines without words are left out."""
    return [w for w in map(words, (text or "").split("\n")) if w]


def _canonical(lines: list[str]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest("\n".join(sorted(lines)))).view(np.int64))


def _prepared(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Class and body of each record with words, and hashes of its lines that are shorter than a phrase."""
    hashed, known = WordHash(), Memo()
    for b in batches:
        out = []
        for k, side, t in zip(b["k"], b["side"], b["t"]):
            known.trim()
            lines = lines_of(t)
            joined = [" ".join(w) for w in lines]
            if joined:
                short = {x: w for x, w in zip(joined, lines) if len(w) < PHRASE}
                for x, w in short.items():
                    if x not in known:
                        known[x] = int(line_ngrams(hashed(w), [len(w)], PHRASE)[0].view(np.int64)[0])
                out.append((k, side, _canonical(joined), "\n".join(joined), [known[x] for x in short]))
        yield pd.DataFrame(out, columns=["k", "side", "form", "body", "short"])


def _hashed(batches: Iterable[pd.DataFrame], short: np.ndarray) -> Iterator[pd.DataFrame]:
    """Words of the lines of each body, its different phrases and the place of each phrase of the text among them.

    To the phrases come those shorter n-grams that may be a short line of another body: whose cell in ``short`` is set.
    """
    hashed = WordHash()
    for b in batches:
        for at in range(0, len(b), 1000):
            part = b.iloc[at : at + 1000]
            lines = [[x.split(" ") for x in body.split("\n")] for body in part["body"]]
            flat, lens = hashed([w for body in lines for line in body for w in line]), [[len(w) for w in body] for body in lines]
            ends = np.cumsum([sum(n) for n in lens])[:-1]
            every = [n for body in lens for n in body]
            of = []
            for n in range(1, PHRASE + 1):
                h, place = line_ngrams(flat, every, n)
                h = h.view(np.int64)
                if n < PHRASE:
                    keep = short[h % CELLS]
                    h, place = h[keep], place[keep]
                of.append(np.split(h, np.searchsorted(place, ends)))
            grams, places = [], []
            for *small, phrases in zip(*of):
                known, code = np.unique(np.concatenate([phrases, *small]), return_inverse=True)
                grams.append(known)
                places.append(code[: len(phrases)].astype(np.int32))
            yield pd.DataFrame({"form": part["form"].to_numpy(), "side": part["side"].to_numpy(), "lens": lens, "grams": grams, "places": places})


def spare_words(n: int, share: float) -> int:
    """Words out of ``n`` that may be missing in a match."""
    u = int(n * (1 - share)) + 1
    while (n - u) / n < share:
        u -= 1
    return u


def questions(lens: np.ndarray, phrases: np.ndarray, df: np.ndarray, share: float) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(need, asked, front, phrases, first, width, lead): a text that has ``share`` of these words has phrases that cover
    ``need`` asked words or more, and ``front`` or more of those that are looked up first.

    Asked for are the words with the rarest phrases around them, ``NEED`` more than a match may lack, so that many of
    them return in each match; ``LEAD`` more, the rarest, are looked up first. A phrase covers ``width`` of the asked
    words from ``first`` on, counted in order of place, and ``lead`` of those looked up first. None: too many words are in
    no phrase of the other side, nothing can match. ``df`` is how often the other side has each phrase; 0 must be certain,
    all else is only a preference.
    """
    n = int(lens.sum())
    line, ends = np.repeat(lens, lens), np.repeat(np.cumsum(lens), lens)
    at = np.arange(n)
    at = at[(at + PHRASE <= ends) | ((at == ends - line) & (line < PHRASE))]
    size = np.minimum(line[at], PHRASE)
    cost = np.zeros(n, dtype=np.int64)
    for q in range(PHRASE):
        long = size > q
        cost[at[long] + q] += df[long]
    spare = spare_words(n, share)
    if np.count_nonzero(cost == 0) > spare:
        return None
    asked = np.argsort(cost, kind="stable")[: spare + NEED]
    front = asked[: spare + LEAD]
    before, ahead = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    before[asked + 1] = ahead[front + 1] = 1
    before, ahead = np.cumsum(before), np.cumsum(ahead)
    weight, lead = before[at + size] - before[at], ahead[at + size] - ahead[at]
    keep = (weight > 0) & (df > 0)
    return len(asked) - spare, len(asked), len(front) - spare, phrases[keep], before[at][keep], weight[keep].astype(np.int8), lead[keep].astype(np.int8)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of ``n``, one run after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Questions:
    """Questions of a block of classes by phrase; ``answer`` gives the classes of which a text covers as many asked words as they need.

    Two steps: lists by phrase of the classes that look it up first, then all phrases of each class that is left.
    """

    def __init__(
        self, form: np.ndarray, side: np.ndarray, need: np.ndarray, asked: np.ndarray, front: np.ndarray, sizes: np.ndarray, g: np.ndarray, first: np.ndarray, width: np.ndarray, lead: np.ndarray
    ) -> None:
        self.form, self.need, self.asked = form, need, asked.astype(np.int64)
        self.known, code = np.unique(g, return_inverse=True)
        self.code, self.first, self.width = code.astype(np.int32), first, width
        self.sizes, self.begin = sizes, np.cumsum(sizes) - sizes
        kind = np.int16 if 3 * PHRASE * sizes.max(initial=0) < 1 << 15 else np.int32
        listed = np.flatnonzero(lead)
        entry = np.repeat(np.arange(len(form)), sizes)[listed]
        part = np.array([0, 0, 2, 1], dtype=np.int8)[side][entry]  # in a list first the questions of side 1, then of both sides, then of side 2
        order = np.lexsort((part, code[listed]))
        self.entry, self.lead = entry[order], lead[listed][order].astype(kind)
        self.short = np.full(-(-len(form) // 8) * 8, -1, dtype=kind)  # what is short of enough, of eight classes at a time
        self.short[: len(form)] = -front
        n = [np.bincount(code[listed][part == p], minlength=len(self.known)) for p in (0, 1, 2)]
        end = np.cumsum(sum(n))
        start = end - sum(n)
        self.range = {1: (start + n[0], end), 2: (start, end - n[2]), 3: (start, end)}  # whom a text of a side answers

    def answer(self, side: Sequence[int], grams: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, class): ``grams`` are the different phrases of each of a few texts."""
        known = self.known
        if not len(known):
            return np.empty(0, dtype=np.int64), self.form[:0]
        have, seen = np.zeros((len(grams), len(known)), dtype=bool), np.empty_like(self.short)
        left = []
        for t, (s, g) in enumerate(zip(side, grams)):
            i = np.minimum(np.searchsorted(known, g), len(known) - 1)
            i = i[known[i] == g]
            have[t, i] = True
            start, end = self.range[s]
            begin = start[i]
            at = _runs(begin, end[i] - begin)
            seen[:] = self.short
            np.add.at(seen, self.entry[at], self.lead[at])  # phrases overlap, so this counts words up to three times
            enough = seen >= 0
            near = (np.flatnonzero(enough.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # few have enough, so eight are seen at once
            left.append(near[enough[near]])
        text = np.repeat(np.arange(len(left)), [len(x) for x in left])
        who = np.concatenate(left)
        if not len(who):
            return text, self.form[who]
        n = self.sizes[who]
        at = _runs(self.begin[who], n)
        has = have.ravel()[np.repeat(text * len(known), n) + self.code[at]]
        keep = np.add.reduceat(self.width[at] * has, np.cumsum(n) - n, dtype=np.int64) >= self.need[who]  # counts too often likewise
        has &= np.repeat(keep, n)
        room = self.asked[who] + 1
        room[~keep] = 1
        base = np.cumsum(room) - room
        place, width = np.repeat(base, n)[has] + self.first[at[has]], self.width[at[has]]
        step = np.zeros(room.sum(), dtype=np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + width, -1)
        keep &= np.add.reduceat((np.cumsum(step) > 0).astype(np.int64), base) >= self.need[who]
        return text[keep], self.form[who[keep]]


def containment(a: str, b: str, known: Memo | None = None) -> float:
    """Share of the words of one body that stand in the other in the same phrases, the larger of both directions.

    A phrase is a run of ``PHRASE`` words of a line (a whole line when it is shorter) that the other body has anywhere;
    so letter case, punctuation, spacing, line order and lost line breaks do not matter, while the same words in another
    order do. ``known`` keeps what was made of a body for its further pairs; it is emptied when it is full.
    """
    known = Memo() if known is None else known
    known.trim()
    for body in (a, b):
        if body not in known:
            lines = [x.split(" ") for x in body.split("\n")]
            known[body] = [(len(w), list(zip(*(w[k:] for k in range(min(PHRASE, len(w))))))) for w in lines], _phrases(lines)
    (la, ha), (lb, hb) = known[a], known[b]
    return max(_covered(la, hb), _covered(lb, ha))


def _phrases(lines: list[list[str]]) -> set[tuple[str, ...]]:
    have: set[tuple[str, ...]] = set()
    for w in lines:
        for n in range(1, PHRASE + 1):
            have.update(zip(*(w[i:] for i in range(n))))
    return have


def _covered(lines: list[tuple[int, list[tuple[str, ...]]]], have: set[tuple[str, ...]]) -> float:
    total = hit = 0
    for size, phrases in lines:
        n, until = min(PHRASE, size), 0
        total += size
        for i, phrase in enumerate(phrases):
            if phrase in have:
                hit += i + n - max(i, until)
                until = i + n
    return hit / total if total else 0.0


def cross_split_pairs(df: DataFrame, key: str, text: str, split: str, train: str = "train", share: float = SHARE) -> DataFrame:
    """(key_a, key_b), key_a < key_b by bytes: a train record and a record of another split with (nearly) the same text.

    1. Records with the same lines, in any order and layout, form one class; only one body per class goes on, so a
       text with a million copies is compared once. 2. Bodies become hashes of the phrases that :func:`containment`
       counts. Of a record that returns in another at most a tenth of the words are missing, so of any set of more words
       some return: each class, of train and evaluation alike because either may be the one contained, asks for the
       words with the rarest phrases around them, ``NEED`` more than may be missing, and every class of the other side
       that covers ``NEED`` of them is a candidate; the rarest of these words are looked up in lists by phrase, the others
       only for classes that have enough of those. No pair that reaches the share can be missed, however common its
       phrases are. 3. Questions are broadcast in blocks of ``BLOCK`` classes and the classes scanned without a shuffle,
       so a common phrase skews no task. 4. Candidates are measured by :func:`containment`, and class pairs expand to the
       record pairs asked for.

    How common a phrase is comes from counts of fixed size; they decide how many candidates there are, never which pairs
    are found. The scans grow with the square of the classes over ``BLOCK``.

    Defined results: null, empty and wordless texts never match; a null split is no split; repeated rows of an id count
    once; pairs within train or within evaluation splits are not asked for; empty tables give no rows.
    """
    members, linked = cross_split_classes(df, key, text, split, train, share)
    left = members.filter("side = 1").select(F.col("form").alias("f1"), F.col("k").alias("a"))
    right = members.filter("side = 2").select(F.col("form").alias("f2"), F.col("k").alias("b"))
    out = linked.join(left, "f1").join(right, "f2").filter("a <> b")
    return out.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def cross_split_classes(df: DataFrame, key: str, text: str, split: str, train: str = "train", share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Membership (k, side, form), side 1 for train, and links (f1, f2) of a class with train records to one with evaluation records.

    This is the result of :func:`cross_split_pairs` before copies are expanded: it grows with the records, not with the
    product of copies on both sides. A class of exact copies on both sides is linked to itself.
    """
    rows = df.select(
        F.col(key).cast("string").alias("k"), F.when(F.col(split) == train, 1).when(F.col(split).isNotNull(), 2).alias("side"), F.col(text).alias("t")
    ).filter("k is not null and side is not null and t is not null")
    ready = cut(spread(rows, "k").mapInPandas(_prepared, "k string, side int, form bigint, body string, short array<bigint>"), "overlap")
    members = ready.select("k", "side", "form").distinct()
    classes = cut(ready.groupBy("form").agg(F.bit_or("side").alias("side"), F.min_by("body", "k").alias("body")), "overlap")
    pairs = _class_pairs(classes, ready.select(F.explode("short").alias("g")), share)
    same = classes.filter("side = 3").select(F.col("form").alias("f1"), F.col("form").alias("f2"))
    both = pairs.unionByName(same).unionByName(pairs.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"))).distinct()
    side = classes.select("form", "side")
    of = lambda c, n: side.filter(F.col("side").bitwiseAND(F.lit(n)) != 0).select(F.col("form").alias(c))
    return members, cut(both.join(of("f1", 1), "f1", "left_semi").join(of("f2", 2), "f2", "left_semi"), "overlap")


def state_links(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(k, class_key, n_links) of every evaluation record with a match in train: the smallest key of its class of copies, and
    how many train records it matches, from the sizes of classes."""
    own = members.groupBy("form").agg(F.min("k").alias("class_key"))
    sizes = members.filter("side = 1").groupBy(F.col("form").alias("f1")).agg(F.count_distinct("k").alias("n"))
    reach = linked.join(sizes, "f1").groupBy(F.col("f2").alias("form")).agg(F.sum("n").alias("n"))
    eval_rows = members.filter("side = 2").join(reach, "form").join(own, "form")
    itself = members.filter("side = 1").select("k", F.col("form").alias("f1")).join(linked, "f1").select("k", F.col("f2").alias("form"), F.lit(1).alias("itself")).join(members.filter("side = 2").select("k", "form"), ["k", "form"], "left_semi").distinct()
    n = F.sum(F.col("n") - F.coalesce("itself", F.lit(0)))  # a key that stands in both splits is no pair with itself
    return eval_rows.join(itself, ["k", "form"], "left").groupBy("k").agg(F.min("class_key").alias("class_key"), n.alias("n_links")).filter("n_links > 0")


def user_links(draft: DataFrame, key: str = "state_id", user: str = "user_id", split: str = "shard", train: str = "train") -> DataFrame:
    """(k, class_key, n_links) of every evaluation draft whose user has drafts in train: the user, and how many those are."""
    d = draft.select(F.col(key).alias("k"), canonical_user(user).alias("u"), F.col(split).alias("s")).dropna().distinct()
    t = d.filter(F.col("s") == train).select("u", "k").distinct()
    sizes = t.groupBy("u").agg(F.count("*").alias("n"))
    e = d.filter(F.col("s") != train).select("u", "k").distinct().join(sizes, "u").join(t.withColumn("itself", F.lit(1)), ["u", "k"], "left")
    n = F.sum(F.col("n") - F.coalesce("itself", F.lit(0)))
    return e.groupBy("k").agg(F.min("u").alias("class_key"), n.alias("n_links")).filter("n_links > 0")


def _class_pairs(classes: DataFrame, short: DataFrame, share: float) -> DataFrame:
    """(f1, f2) of different classes, one with a train record and one with an evaluation record, that match.

    ``short`` has the hash ``g`` of each line that is shorter than a phrase.
    """
    spark = classes.sparkSession
    bits = np.zeros(CELLS, dtype=bool)
    bits[short.select(F.pmod("g", F.lit(CELLS)).alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True  # at most CELLS rows
    shorts = spark.sparkContext.broadcast(bits)
    hashed = cut(
        spread(classes, "form").mapInPandas(lambda batches: _hashed(batches, shorts.value), "form bigint, side int, lens array<int>, grams array<bigint>, places array<int>"), "overlap"
    )
    cells = hashed.select("side", F.explode("grams").alias("g")).groupBy(F.pmod("g", F.lit(CELLS)).alias("cell"))
    seen = cells.agg(F.count_if(F.col("side") != 2).alias("n1"), F.count_if(F.col("side") != 1).alias("n2")).toArrow()  # at most CELLS rows
    table = np.zeros((2, CELLS), dtype=np.int64)
    for k in (0, 1):
        table[k, seen["cell"].to_numpy()] = seen[f"n{k + 1}"].to_numpy()
    counts = spark.sparkContext.broadcast(table)

    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n1, n2 = counts.value
        other = {1: n2, 2: n1, 3: n1 + n2}
        for b in batches:
            out = []
            for form, side, lens, grams, places in zip(b["form"], b["side"], b["lens"], b["grams"], b["places"]):
                asked = questions(lens, grams[places], other[side][grams % CELLS][places], share)
                if asked:
                    out.append((form, side, *asked))
            yield pd.DataFrame(out, columns=["form", "side", "need", "asked", "front", "g", "first", "width", "lead"])

    kinds = "form bigint, side int, need int, asked int, front int, g array<bigint>, first array<int>, width array<tinyint>, lead array<tinyint>"
    asked = cut(spread(hashed, "form", least=1).mapInPandas(ask, kinds), "overlap")
    blocks = -(-asked.count() // BLOCK)
    hits = None
    for block in range(blocks):
        found = _answers(hashed, asked.filter(F.pmod(F.xxhash64("form"), F.lit(blocks)) == block))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return classes.select(F.col("form").alias("f1"), F.col("form").alias("f2")).limit(0)
    hits = hits.distinct()
    body = classes.select("form", "body")
    both = hits.join(body.select(F.col("form").alias("f1"), F.col("body").alias("b1")), "f1").join(
        body.select(F.col("form").alias("f2"), F.col("body").alias("b2")), "f2"
    )

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Memo(3000, 5_000_000)
        for b in batches:
            keep = [containment(x, y, known) >= share for x, y in zip(b["b1"], b["b2"])]
            yield b.loc[keep, ["f1", "f2"]]

    return cut(both.mapInPandas(measure, "f1 bigint, f2 bigint"), "overlap")


def _answers(hashed: DataFrame, asked: DataFrame) -> DataFrame:
    """(f1, f2): classes that ask and classes of the other side that have as much as they need."""
    t = asked.toArrow()
    flat = [t[c].combine_chunks().flatten().to_numpy() for c in ("g", "first", "width", "lead")]
    sizes = pc.list_value_length(t["g"].combine_chunks()).to_numpy().astype(np.int64)
    block = hashed.sparkSession.sparkContext.broadcast(Questions(*(t[c].to_numpy() for c in ("form", "side", "need", "asked", "front")), sizes, *flat))
    del t, flat

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = block.value  # made once, by the driver
        for b in batches:
            side, forms, grams = (b[c].to_numpy() for c in ("side", "form", "grams"))
            f1, f2 = [], []
            for at in range(0, len(b), TEXTS):
                text, other = known.answer(side[at : at + TEXTS], grams[at : at + TEXTS])
                form = forms[at + text]
                keep = form != other
                f1.append(np.minimum(form, other)[keep])
                f2.append(np.maximum(form, other)[keep])
            yield pd.DataFrame({"f1": np.concatenate(f1) if f1 else [], "f2": np.concatenate(f2) if f2 else []}, dtype=np.int64)

    found = cut(spread(hashed, "form", least=1).select("form", "side", "grams").mapInPandas(scan, "f1 bigint, f2 bigint"), "overlap")
    block.destroy()
    return found


def cross_split_users(draft: DataFrame, key: str = "state_id", user: str = "user_id", split: str = "shard", train: str = "train") -> DataFrame:
    """(key_a, key_b), key_a < key_b: two drafts of one user, one in train, the other in another split.

    An equi-join on the user's one spelling; a user with very many drafts is a skewed key, which the adaptive join
    splits. Defined results: null users and splits match nothing; repeated rows count once.
    """
    d = draft.select(F.col(key).alias("k"), canonical_user(user).alias("u"), F.col(split).alias("s")).dropna().distinct()
    a = d.filter(F.col("s") == train).select("u", F.col("k").alias("a"))
    b = d.filter(F.col("s") != train).select("u", F.col("k").alias("b"))
    out = a.join(b, "u").filter("a <> b")
    return out.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def overlap_counts(links: DataFrame, df: DataFrame, key: str, split: str, source: str, train: str = "train") -> DataFrame:
    """(split, source, n_pairs, n_records): overlaps by evaluation split and source of the evaluation record, from its number of links."""
    r = df.select(F.col(key).cast("string").alias("k"), F.col(split).alias("split"), F.col(source).alias("source")).filter(F.col("split") != train).distinct()
    return links.join(r, "k").groupBy("split", "source").agg(F.sum("n_links").alias("n_pairs"), F.count_distinct("k").alias("n_records"))
