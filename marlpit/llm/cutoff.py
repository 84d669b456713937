"""Text cut off by field limits: near-copies whose alignment ends early, and closing-word terminality for the rest."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions.bitmap import KeyBits, key_bits
from marlpit.functions.memo import Memo
from marlpit.functions.shingles import MinHasher, mix
from marlpit.session import cut, spread

GRAM, BANDS, ROWS = 5, 6, 4  # five-word shingles; 4 rows in 6 bands find a pair of similarity 0.8 with probability 0.96, one of 0.3 with 0.05
SIMILAR = 0.8
FIRST_WINDOW, WIDER = 8, 1.15  # words of the shortest opening that is banded; the next is a word, or 15 percent, longer
STOP, CONT, BARE = 0, 1, 2
TERMINAL = 0.12  # closings that end a sentence less often than this are cut
MIN_SEEN = 3

#: What exporters leave behind a cut, and remains of an escape sequence or a character.
MARKS = re.compile(r"(?:(?:\.{2,}|…)\s*(?:\(more\)|more|read more|see more|see full review|continue reading|show more)|\[(?:\.{3}|…)\]|\(truncated\)|\[truncated\])\s*$", re.I)
LEFTOVER = re.compile(r"(?:�+|&(?:#?\w{0,6})|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?|[nrt\"]?)|%[0-9a-fA-F]?|<[/a-zA-Z]{0,5})$")
_DOTS = re.compile(r"(?:\.{2,}|…)\s*$")
_ENDED = re.compile(r"[.!?。！？।؟:;)\]}>\"'”’»*~^_|/]$")
#: What begins a sign-off; capitalised names follow.
SIGNED = re.compile(r"(?:^|\s)(?:Regards|Cheers|Thanks|Signed|From|Attn|Grüße|Saludos?|saludos?|Merci|Cordialement|Sincerely)[,:]?(?:\s+[A-ZÀ-Þ][\w'’.\-]*,?){1,4}$")
_STRIP = ".,;:!?\"'()[]{}<>*_~`“”‘’«»¡¿…-–—"
_NOTHING = np.empty(0, dtype=np.uint64)
SHIFT = 2  # words around an opening's end with whose heads a key is combined: where the alignment of a short text can end
ANY_HEAD = 0


def head_code(word: str) -> int:
    """A code of 12 bits, not 0, for the first two letters of a word."""
    return (zlib.crc32(word[:2].encode("utf-8", "surrogatepass")) & 0xFFE) + 1


def headed(keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Band keys combined with the head of a word."""
    with np.errstate(over="ignore"):
        return mix(keys ^ mix(heads + np.uint64(0x9E3779B97F4A7C15)))


class Tokens(Memo):
    """Whitespace tokens to positions in the tables of word hashes, sentence ends and word heads; emptied between batches when full."""

    def __init__(self, room: int = 200_000) -> None:
        super().__init__(room)
        self.hashes: list[int] = []
        self.stops: list[bool] = []
        self.heads: list[int] = []
        self.raws: list[int] = []

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self.hashes)
        word = token.strip(_STRIP)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self.heads.append(head_code(word))
        self.raws.append(xxhash.xxh64_intdigest(token, seed=1))
        self.stops.append(token.rstrip("\"')]}”’»*_")[-1:] in ".!?。！？।…")
        return n

    def trim(self) -> bool:
        full = super().trim()
        if full:
            self.hashes, self.stops, self.heads, self.raws = [], [], [], []
        return full


EDGE = np.uint64(0x5851F42D4C957F2D)  # stands for the start of a sentence


FREE = np.uint64(3)  # the two lowest bits of a context key are 0, so that a kind fits beside it


def _keyed(h: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.asarray(h, dtype=np.uint64) ^ np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64))) & ~FREE


def contexts(w: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Keys of the suffixes of one, two and three words that end at each word; ``first`` marks sentence starts.

    A suffix does not reach over a sentence start; what is missing there is the start itself.
    """
    if not len(w):
        return [w, w, w]
    with np.errstate(over="ignore"):
        p1 = np.where(first, EDGE, np.concatenate([[EDGE], w[:-1]]))
        second = first | np.concatenate([[True], first[:-1]])
        p2 = np.where(second, EDGE, np.concatenate([[EDGE, EDGE], w[:-2]])[: len(w)])
        two = mix(w * np.uint64(3) + mix(p1))
        three = mix(two + mix(p2 * np.uint64(5)))
    return [_keyed(w, 1), _keyed(two, 2), _keyed(three, 3)]


def prefix_keys(before: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Keys of "a longer word with this prefix follows that word"; ``before`` is 0 for any word."""
    with np.errstate(over="ignore"):
        return _keyed(mix(np.asarray(before, dtype=np.uint64)) ^ np.asarray(prefix, dtype=np.uint64), 9)


def prefix_hashes(word: str) -> np.ndarray:
    """Hashes of all proper prefixes of a word, in one pass over it."""
    h, out = xxhash.xxh64(), []
    for c in word[:-1]:
        h.update(c)
        out.append(h.intdigest())
    return np.array(out, dtype=np.uint64)


def _next(w: int) -> int:
    return max(w + 1, int(w * WIDER))


def windows(n: int) -> list[int]:
    """Sizes of the openings of a text of ``n`` words that are banded."""
    out, w = [], FIRST_WINDOW
    while w <= n:
        out.append(w)
        w = _next(w)
    return out


def opening(n: int) -> int:
    """The largest of :func:`windows`, 0 without any."""
    w = 0
    while (longer := _next(w) if w else FIRST_WINDOW) <= n:
        w = longer
    return w


def decisive(w: int) -> int:
    """Words of a text that decide whether a text that asks with an opening of ``w`` words is its copy and ends early."""
    most = _next(w)
    return most + most // 10 + 1


class Openings:
    """Min-hash band keys of the openings of texts, by size of the opening."""

    def __init__(self) -> None:
        self.hasher = MinHasher(BANDS * ROWS, seed=11)

    def keys(self, w: np.ndarray, starts: np.ndarray, sizes: list[np.ndarray]) -> np.ndarray:
        """openings x bands keys, text after text; the words of text i begin at ``starts[i]`` and its opening sizes ascend.

        The shingles of an opening are those of the shorter ones and some more, so its minima are running minima.
        """
        if not sizes:
            return np.empty((0, BANDS), dtype=np.uint64)
        padded = np.append(w, np.zeros(GRAM, dtype=np.uint64))
        h = np.zeros(len(w), dtype=np.uint64)
        many = np.array([len(s) for s in sizes])
        size, top = np.concatenate(sizes), np.array([s[-1] for s in sizes]) - GRAM + 1
        base = np.cumsum(top) - top
        fresh = np.zeros(len(size), dtype=bool)
        fresh[np.cumsum(many) - many] = True
        ahead = np.where(fresh, 0, np.concatenate([[0], size[:-1] - GRAM + 1]))
        with np.errstate(over="ignore"):
            for k in range(GRAM):
                h = mix(h * np.uint64(7) + padded[k : k + len(w)])
            h = h[np.repeat(starts - base, top) + np.arange(top.sum())]
            minima = self.hasher.minima(h, np.repeat(base, many) + ahead)
            step = np.arange(len(size)) - np.repeat(np.cumsum(many) - many, many)
            for k in range(1, many.max()):
                todo = np.flatnonzero(step == k)
                minima[:, todo] = np.minimum(minima[:, todo], minima[:, todo - 1])
            out = np.empty((len(size), BANDS), dtype=np.uint64)
            tag = size.astype(np.uint64) * np.uint64(1_000_003)
            for b in range(BANDS):
                key = tag + np.uint64(b + 1)
                for r in range(ROWS):
                    key = mix(key * np.uint64(31) + minima[b * ROWS + r])
                out[:, b] = key
        return out


def suspicious(text: str) -> bool:
    """Whether a text does not end like a sentence: the only ones that can be cut copies or unterminated."""
    body = text.rstrip()
    return bool(body) and (not _ENDED.search(body) or bool(MARKS.search(body[-48:])) or bool(LEFTOVER.search(body[-12:])) or bool(_DOTS.search(body[-12:])))


_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _maybe_suspicious(text: Column) -> Column:
    """A superset of :func:`suspicious` inside the engine, so that most texts are not judged in Python."""
    end = F.rtrim(F.right(text, F.lit(100)), F.lit(_BLANK))
    return ~F.right(end, F.lit(1)).rlike(r"[.!?。！？।؟:;)\]}>\"'”’»*~^_|/]") | F.right(end, F.lit(48)).rlike(r"(?i)\.\.|…|ated\]|ated\)|more\)|\[|[\\%<�]|&")


_ALL = (1 << 64) - 1


def _mix1(h: int) -> int:
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    return h ^ (h >> 31)


def _key1(h: int, order: int) -> int:
    return _mix1(h ^ (order * 0x9E3779B97F4A7C15 & _ALL)) & ~3


def closing_keys(tail: list[int], part: int) -> list[int]:
    """:func:`contexts` of the last word, given the hashes of up to three closing words of its sentence, and its :func:`prefix_keys`."""
    edge = int(EDGE)
    w, p1, p2 = tail[-1], tail[-2] if len(tail) > 1 else edge, tail[-3] if len(tail) > 2 else edge
    two = _mix1((w * 3 + _mix1(p1)) & _ALL)
    return [_key1(w, 1), _key1(two, 2), _key1(_mix1((two + _mix1(p2 * 5 & _ALL)) & _ALL), 3), _key1(_mix1(0) ^ part, 9), _key1(_mix1(p1) ^ part, 9)]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Asked:
    """What must be known about suspicious texts: keys of their closing contexts and the bands of their openings."""

    def __init__(self) -> None:
        self.tokens, self.openings = Tokens(), Openings()

    def __call__(self, forms: list[int], texts: list[str]) -> list[tuple]:
        """(form, marked, alphabetic last word, short capital word, context keys, band keys, those with the head of the last word, words, signed) of those that may be cut."""
        out, wide, at, heads = [], [], [], []
        self.tokens.trim()
        for form, text in zip(forms, texts):
            if not suspicious(text):
                continue
            body = text.rstrip()
            left = LEFTOVER.search(body[-12:])
            if MARKS.search(body[-48:]) or left and left.group() not in ("&", "%", "<"):
                out.append((form, True, False, False, [], [], [], 0, False))
                continue
            core = _DOTS.sub("", body).rstrip()
            if not core or _ENDED.search(core) or not core[-1].isalnum():
                continue
            last, lower = core.split()[-1], core.lower().split()
            info = [self.tokens[t] for t in lower]
            close = info[-12:]
            begin = max((i + 1 for i, n in enumerate(close[:-1]) if self.tokens.stops[n]), default=0)
            tail = [self.tokens.hashes[n] for n in close[max(begin, len(close) - 3) :]]
            keys = closing_keys(tail, xxhash.xxh64_intdigest(lower[-1].strip(_STRIP)))
            size = opening(len(info) - 1)
            if size:
                word = lower[-1].strip(_STRIP)
                wide.append(info[:size])
                at.append(len(out))
                heads.append(head_code(word) if len(word) > 1 and len(info) - 1 - size + len(info) // 10 <= SHIFT else ANY_HEAD)
            out.append((form, False, lower[-1].isalpha(), last.isupper() and len(last) < 4, list(map(_signed, keys)), [], [], len(info), bool(SIGNED.search(core[-80:]))))
        sizes = [np.array([len(x)]) for x in wide]
        starts = np.cumsum([0, *map(len, wide)])[:-1]
        flat = np.array(self.tokens.hashes, dtype=np.uint64)[[n for x in wide for n in x]] if wide else _NOTHING
        plain = self.openings.keys(flat, starts, sizes)
        asked = headed(plain, np.array(heads, dtype=np.uint64).reshape(-1, 1))
        for i, p, k in zip(at, plain.view(np.int64).tolist(), asked.view(np.int64).tolist()):
            out[i][5].extend(p)
            out[i][6].extend(k)
        return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values and how often each stands there."""
    v = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, dtype=np.int64)
    return v[first], np.diff(np.append(first, len(v)))


class Scan:
    """One pass over texts: counts of the asked contexts, and band keys of openings that some suspicious text asks for.

    The bits of the asked keys only save work: a key that no text asked for may be counted in vain, none is left out.
    """

    def __init__(self, bits: KeyBits) -> None:
        self.bits, self.tokens, self.openings = bits, Tokens(), Openings()
        self.prefixes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.load = 0

    def add(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Counts the texts; returns (text, key, words, class) of the asked band keys, combined with the heads around the opening's end.

        Texts of a class have the same words as far as they decide about the copies that ask for the key; one stands for all.
        """
        if self.tokens.trim():
            self.prefixes = []
        get = self.tokens.__getitem__
        flat: list[int] = []
        lengths = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            toks = t.lower().split()
            lengths[i] = len(toks)
            flat.extend(map(get, toks))
        if not flat:
            return self._bands(_NOTHING, none := np.empty(0, dtype=np.int64), none, none, _NOTHING)
        ids = np.array(flat)
        w, stop = np.array(self.tokens.hashes, dtype=np.uint64)[ids], np.array(self.tokens.stops, dtype=bool)[ids]
        ends = np.cumsum(lengths)
        last = np.zeros(len(w), dtype=bool)
        last[ends[lengths > 0] - 1] = True
        first = np.concatenate([[True], (stop | last)[:-1]])
        kind = np.where(stop, STOP, np.where(last, BARE, CONT))
        _, two, three = contexts(w, first)
        self._count(np.concatenate([two, three]), np.concatenate([kind, kind]))
        known = np.array(self.tokens.hashes, dtype=np.uint64)
        n = np.bincount(ids * 3 + kind, minlength=3 * len(known))
        at = np.flatnonzero(n)
        self._count(_keyed(known, 1)[at // 3], at % 3, n[at])
        inner = ~(last & ~stop)  # a bare last word may be a cut one and is no word to learn
        before = np.where(first, EDGE, np.concatenate([[EDGE], w[:-1]]))
        of = self._prefixes()
        size = np.array([len(p) for p in of], dtype=np.int64)
        if size.any():
            flat_p = np.concatenate(of)
            n = np.bincount(ids[inner], minlength=len(known))
            self._count(prefix_keys(np.zeros(1, dtype=np.uint64), flat_p), np.full(len(flat_p), CONT), np.repeat(n, size))
            take = np.flatnonzero(inner & (size[ids] > 0))
            n = size[ids[take]]
            start = (np.cumsum(size) - size)[ids[take]]
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self._count(prefix_keys(np.repeat(before[take], n), flat_p[at]), np.full(len(at), CONT))
        raw = np.array(self.tokens.raws, dtype=np.uint64)[ids]
        return self._bands(w, ends - lengths, lengths, np.array(self.tokens.heads)[ids], raw)

    def _prefixes(self) -> list[np.ndarray]:
        """Of each known token the hashes of those proper prefixes that some text asks for."""
        fresh = [prefix_hashes(t.strip(_STRIP)) for t in islice(self.tokens, len(self.prefixes), None)]
        if fresh:
            flat = np.concatenate(fresh)
            known = np.concatenate([[0], np.cumsum(hit := self.bits.has(prefix_keys(np.zeros(1, dtype=np.uint64), flat)))])
            ends = np.cumsum([len(h) for h in fresh])
            flat = flat[hit]
            self.prefixes += [flat[known[e - len(h)] : known[e]] for h, e in zip(fresh, ends)]
        return self.prefixes

    def _count(self, keys: np.ndarray, kinds: np.ndarray, times: np.ndarray | None = None) -> None:
        asked = self.bits.has(keys)
        both = keys[asked] | kinds[asked].astype(np.uint64)
        if times is None:
            both, times = _runs(both)
        else:
            both, times = both[times[asked] > 0], times[asked][times[asked] > 0]
        self.keys.append(both)
        self.counts.append(times)
        self.load += len(both)

    def full(self) -> bool:
        return self.load > 2_000_000

    def counted(self) -> pd.DataFrame:
        """(key, s, c, b) so far; the counts begin anew."""
        both, code = np.unique(np.concatenate([*self.keys, _NOTHING]), return_inverse=True)
        n = np.bincount(code, weights=np.concatenate([*self.counts, np.empty(0)]), minlength=len(both)).astype(np.int64)
        key, kind = (both & ~FREE).view(np.int64), (both & FREE).astype(np.int64)
        self.keys, self.counts, self.load = [], [], 0
        return pd.DataFrame({"key": key, "form": np.int64(0), "s": n * (kind == STOP), "c": n * (kind == CONT), "b": n * (kind == BARE), "cls": np.int64(0)})

    def _bands(self, w: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
        wide = np.flatnonzero(lengths >= FIRST_WINDOW)
        known = {n: np.array(windows(n)) for n in np.unique(lengths[wide]).tolist()}
        sizes = [known[n] for n in lengths[wide].tolist()]
        keys = self.openings.keys(w, starts[wide], sizes)
        hit = self.bits.has(keys.ravel())
        key, size = keys.ravel()[hit], np.repeat(np.concatenate(sizes or [starts[:0]]), BANDS)[hit]
        owner = np.repeat(np.repeat(wide, [len(s) for s in sizes]), BANDS)[hit]
        start, n = starts[owner], lengths[owner]
        codes = np.zeros((len(owner), 2 * SHIFT + 2), dtype=np.uint64)  # the last column: any head
        for k in range(-SHIFT, SHIFT + 1):
            at = start + size + k
            inside = size + k < n
            codes[inside, k + SHIFT] = heads[at[inside]]
        with np.errstate(over="ignore"):
            place = (np.arange(len(raw)) - np.repeat(starts, lengths)).astype(np.uint64)
            upto = np.concatenate([[np.uint64(0)], np.cumsum(mix(raw ^ mix(place + np.uint64(1))))])
            far = {s: decisive(s) for s in np.unique(size).tolist()}
            read = np.minimum(np.array([far[s] for s in size.tolist()], dtype=np.int64), n)
            word_hash = upto[start + read] - upto[start]
            key = headed(key[:, None], codes)
            row, col = np.nonzero(self.bits.has(key.ravel()).reshape(key.shape))
            key = key[row, col]
            cls = mix(word_hash[row] + key)
        _, one = np.unique(cls, return_index=True)
        return owner[row[one]], key[one], n[row[one]], cls[one]


def _plain(text: str) -> list[str]:
    body = _DOTS.sub("", LEFTOVER.sub("", MARKS.sub("", text.rstrip()).rstrip()).rstrip()).rstrip()
    return [t.strip(_STRIP) for t in body.lower().split()]


def _grams(x: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(x[i:] for i in range(GRAM)))) or {tuple(x)}


def copy_verdict(x: list[str], y: list[str], raw: list[str]) -> int:
    """1: the words ``x`` align with the opening of the longer ``y`` and end early, inside a word or a sentence of it; 0: they
    end where a sentence of ``y`` ends; -1: no copy of similarity ``SIMILAR``. ``raw`` are the words of y as they stand."""
    n = len(x)
    if n < 2 or len(y) < n - (n - 1) // 10:
        return -1
    at = _aligned(x, y)
    if at is None:
        return -1
    if x[:-1] != y[:at]:
        sx, sy = _grams(x[:-1]), _grams(y[:at])
        if len(sx & sy) < SIMILAR * len(sx | sy):
            return -1
    if len(y[at]) > len(x[-1]):
        return 1
    if raw[at].rstrip("\"')]}”’»")[-1:] in ".!?。！？।…" or (len(y) > at + 1 and not y[at + 1]):  # a mark or dots that stand alone
        return 0
    return 1 if len(y) > at + 1 else -1


def _aligned(x: list[str], y: list[str]) -> int | None:
    """Where in ``y`` the last word of ``x``, or the word it begins, stands, when all words before it align with those of ``x``.

    A tenth of the words may be changed, left out or put in; a banded alignment from the start of both.
    """
    n, last = len(x) - 1, x[-1]
    wide = n // 10
    if len(y) > n and y[n].startswith(last) and (x[:n] == y[:n] or sum(p != q for p, q in zip(x[:n], y)) <= wide):
        return n
    far = wide + 1
    if len(set(x[:n]).difference(y[: n + wide])) > wide:
        return None
    row = {j: j for j in range(min(wide, len(y)) + 1)}
    for i in range(1, n + 1):
        word, new = x[i - 1], {}
        for j in range(max(0, i - wide), min(len(y), i + wide) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, new.get(j - 1, far) + 1, row.get(j - 1, far) + (word != y[j - 1]))
            new[j] = best
        row = new
        if min(row.values(), default=far) > wide:
            return None
    ends = [(d, abs(j - n), j) for j, d in row.items() if d <= wide and j < len(y) and y[j].startswith(last)]
    return min(ends)[2] if ends else None


def _terminal(s: str, c: str, b: str) -> Column:
    """Whether a context ends sentences too rarely to be an end; bare ends count unless they are rare against going on."""
    s_, c_, b_ = F.col(s), F.col(c), F.col(b)
    return (s_ + F.when(s_ + b_ > c_ / 50, b_).otherwise(0)) / (s_ + c_ + b_) < TERMINAL


def _unterminated() -> Column:
    """Terminality of the closing words from the counts of their contexts (1, 2, 3 words) and of longer words (4, 5)."""
    seen = lambda i: F.col(f"s{i}") + F.col(f"c{i}")
    enough = lambda i: (seen(i) > 1) | (F.col(f"b{i}") >= MIN_SEEN)
    here, longer = F.col("c5"), F.col("c4")
    half = (longer >= MIN_SEEN) & (seen(1) <= longer / 200) & F.col("alpha") & ~F.col("short")
    return (
        F.when(F.col("signed"), half)  # names after a sign-off are an end, half a name is none
        .when((here >= MIN_SEEN) & (seen(2) <= here / 50), F.col("b2") <= here / 50)  # only ever the beginning of the word that stands here
        .when(enough(3), _terminal("s3", "c3", "b3"))
        .when(enough(2), _terminal("s2", "c2", "b2"))
        .when((longer >= MIN_SEEN) & (seen(1) <= longer / 200) & F.col("alpha"), half)
        .when(seen(1) > 1, _terminal("s1", "c1", "b1"))
        .otherwise(False)
    )


_ODD = "form bigint, marked boolean, alpha boolean, short boolean, ctx array<bigint>, plain array<bigint>, bands array<bigint>, n int, signed boolean"


def _asked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ask = Asked()
    for b in batches:
        yield pd.DataFrame(ask(b["form"].tolist(), b["text"].tolist()), columns=["form", "marked", "alpha", "short", "ctx", "plain", "bands", "n", "signed"])


def cut_rows(rows: DataFrame) -> DataFrame:
    """(tbl, row_key, source, cut) of every row of (tbl, row_key, source, text) with a non-empty text.

    1. Texts that do not end like a sentence are taken aside: each asks for how often the corpus has its closing contexts
       and for the min-hash bands of its longest opening (sizes grow by ``WIDER``). 2. One pass over all texts counts the
       asked contexts, exactly: how often each ends a sentence, goes on, or ends a text bare, and which longer words
       follow a word; and gives the asked bands of all their openings, so a short rest meets the whole text it was cut
       from. 3. Every such text is aligned with each longer different text of its buckets. An alignment of similarity 0.8
       or more that ends inside a word or sentence makes it cut, one that ends with a sentence makes it complete. 4. Texts
       without a copy are scored by the terminality of their closing words. Marks that exporters leave behind a cut
       (``[...]``, ``... (more)``, half an escape) count as cut.

    What tasks share are the bits of the asked keys, of bounded size; they save work and decide nothing.

    Defined results: null, empty and blank texts are no rows; a text that lacks a full stop, ends in dots, a sign-off or
    an emoji after whole sentences is complete; repeated rows are judged alike; an empty table gives no rows; texts are
    read whole, whatever their length.
    """
    base = rows.select("tbl", "row_key", "source", "text", F.xxhash64("text").alias("form")).filter(r"left(text, 40) rlike '(?U)\\S' or text rlike '(?U)\\S'")
    odd = cut(base.filter(_maybe_suspicious(F.col("text"))).select("form", "text").mapInPandas(_asked, _ODD).dropDuplicates(["form"]), "cutoff")
    bits = rows.sparkSession.sparkContext.broadcast(key_bits(odd.select(F.explode(F.concat("ctx", "plain", "bands")).alias("key"))))

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Scan(KeyBits(bits.value))
        for b in batches:
            owner, keys, n, cls = one.add(b["text"].tolist())
            yield pd.DataFrame({"key": keys.view(np.int64), "form": b["form"].to_numpy()[owner], "s": n, "c": np.int64(-1), "b": np.int64(0), "cls": cls.view(np.int64)})
            if one.full():
                yield one.counted()
        yield one.counted()

    seen = cut(spread(base, "row_key").select("form", "text").mapInPandas(scan, "key bigint, form bigint, s bigint, c bigint, b bigint, cls bigint"), "cutoff")
    counts = seen.filter("c >= 0").groupBy("key").agg(*[F.sum(x).alias(x) for x in "scb"])
    each = odd.filter("not marked").select("form", "alpha", "short", "signed", F.posexplode("ctx").alias("i", "key")).join(counts, "key", "left")
    wide = [F.coalesce(F.max(F.when(F.col("i") == i - 1, F.col(x))), F.lit(0)).alias(f"{x}{i}") for i in range(1, 6) for x in "scb"]
    scored = each.groupBy("form").agg(F.first("alpha").alias("alpha"), F.first("short").alias("short"), F.first("signed").alias("signed"), *wide).select("form", _unterminated().alias("open"))
    classes = seen.filter("c = -1").groupBy("key", "cls").agg(F.min("form").alias("f2"), F.max("s").alias("n2"))
    copies = _copies(odd, classes, base)
    verdict = scored.join(copies, "form", "left").select("form", F.coalesce("early", "open").alias("cut")).unionByName(odd.filter("marked").select("form", F.lit(True).alias("cut")))
    return base.drop("text").join(verdict, "form", "left").select("tbl", "row_key", "source", F.coalesce("cut", F.lit(False)).alias("cut"))


def _copies(odd: DataFrame, partners: DataFrame, base: DataFrame) -> DataFrame:
    """(form, early) of suspicious texts with a longer near-copy: whether the alignment with any of them ends early.

    A suspicious text is tried with all texts of its buckets that are at least as long and in which a word where the
    alignment may end begins like its last word. Texts that agree in all the words that decide are one, so a sentence that
    opens a third of all texts gives as many pairs as it has different continuations; what is left of a hot bucket is a
    skewed key, which the adaptive join splits.
    """
    ask = odd.select("form", "n", F.explode("bands").alias("key"))
    near = ask.join(partners, "key").filter("f2 <> form and n2 >= n - n div 10")
    pairs = cut(near.select("form", "f2").distinct(), "cutoff")
    asked = pairs.select("form").unionByName(pairs.select(F.col("f2").alias("form"))).distinct()
    text = cut(base.select("form", "text").join(asked, "form", "left_semi").dropDuplicates(["form"]), "cutoff")
    both = pairs.join(text, "form").join(text.select(F.col("form").alias("f2"), F.col("text").alias("other")), "f2")

    def align(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain: dict[str, list[str]] = {}
            out = []
            for form, t, o in zip(b["form"], b["text"], b["other"]):
                x = plain.get(t)
                if x is None:
                    x = plain[t] = _plain(t)
                most = len(x) + len(x) // 10 + 1  # words that decide
                raw = [w.lower() for w in o.split(None, most)[:most]]
                v = copy_verdict(x, [w.strip(_STRIP) for w in raw], raw)
                if v >= 0:
                    out.append((form, bool(v)))
            yield pd.DataFrame(out, columns=["form", "early"])

    return both.mapInPandas(align, "form bigint, early boolean").groupBy("form").agg(F.max("early").alias("early"))


def cut_found(judged: DataFrame) -> DataFrame:
    return judged.filter("cut").select("tbl", "row_key").distinct()


def cut_rates(judged: DataFrame) -> DataFrame:
    """(tbl, source, n_texts, n_cut, cut_rate): how often each source truncates its non-empty texts."""
    return judged.groupBy("tbl", "source").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_rate")
    )
