"""Personal information inside free text: a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.bitmap import KeyBits, key_bits
from marlpit.session import cut, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
NAME_TOKENS = 4  # bound on the words of a name segment; other segments are bounded by their patterns
KNOWN = 3  # places inside sentences with a capital from which on a proper word is well known; rarer ones are candidates too
PROPER_SHARE = 0.3  # of a proper word's places inside sentences it has a capital in at least so many
INNER_SHARE = 0.12  # and so many of its places are inside sentences

_DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_HOST = r"[\w\-]+"
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|punkt|punto|point)\s?[\])]\s?|\s(?:dot|punkt|punto|point)\s)"
_AT = r"(?:[@＠]|\s?[\[(]\s?(?:at|@)\s?[\])]\s?)"
_EDGE, _END = r"(?<![\w.\-+/#$€£])", r"(?![\w/]|[\-.:]\d)"
_SUFFIX = "(?:street|str|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|close|place|pl|way|terrace|ter|boulevard|blvd|square|sq|crescent|cres|row|mews|walk|grove|parkway|pkwy|circle|cir|alley|highway|hwy)"
_UNIT = r"(?:(?:flat|apt\.?|apartment|unit|suite|ste\.?|piso)\s?\#?\w{1,4},?\s+)?"
_UNIT_AFTER = r"(?:,?\s+(?:flat|apt\.?|apartment|unit|suite|ste\.?|\#)\s?\#?\w{1,4}\b)?"
_TOWN = r"(?:,\s+[^\W\d_][\w'\-]+(?:\s[^\W\d_][\w'\-]+)?\s+\d{4,5}\b)?"

#: Segment families: permissive shapes of whole values; the field decides which of the overlapping candidates hold.
FAMILIES: list[tuple[str, str, re.Pattern[str]]] = [
    ("email", "plain", re.compile(rf"(?<![\w.+\-])[\w.+\-]*\w[\w.+\-]*[@＠]{_HOST}(?:\.{_HOST})+", re.I)),
    ("email", "marked", re.compile(rf"(?<![\w.+\-])[\w.+\-]+(?:{_DOT}[\w.+\-]+)*{_AT}{_HOST}(?:{_DOT}{_HOST})+", re.I)),
    ("email", "worded", re.compile(rf"(?<![\w.+\-])[\w+\-]+(?:\s(?:dot|punkt|punto|point)\s[\w+\-]+)*\s(?:at|arroba|chez)\s{_HOST}(?:\s(?:dot|punkt|punto|point)\s{_HOST})+", re.I)),
    ("phone", "country", re.compile(rf"{_EDGE}(?:\+|00)\d{{1,3}}[\s.\-]?\(?\d{{1,4}}\)?(?:[\s.\-]?\d{{2,5}}){{1,4}}{_END}")),
    ("phone", "area", re.compile(rf"{_EDGE}(?:1[\s.\-])?(?:\(\d{{3}}\)\s?|\d{{3}}[\s.\-])\d{{3}}[\s.\-]\d{{4}}{_END}")),
    ("phone", "ten", re.compile(rf"{_EDGE}[2-9]\d{{9}}{_END}")),
    ("phone", "local", re.compile(rf"{_EDGE}[2-9]\d{{2}}[\s.\-]\d{{4}}{_END}")),
    ("phone", "worded", re.compile(rf"\b(?:{_DIGIT_WORD}[\s,\-]+){{6,14}}{_DIGIT_WORD}\b", re.I)),
    ("id_number", "three", re.compile(rf"{_EDGE}\d{{3}}[\s.\-]\d{{2}}[\s.\-]\d{{4}}{_END}")),
    ("id_number", "nine", re.compile(rf"{_EDGE}\d{{9}}{_END}")),
    ("id_number", "letters", re.compile(rf"{_EDGE}[A-Za-z]{{2}}[\s\-]?\d{{2}}[\s\-]?\d{{2}}[\s\-]?\d{{2}}[\s\-]?[A-Da-d]{_END}")),
    ("id_number", "check", re.compile(rf"{_EDGE}(?:\d{{8}}|[XYZxyz][\s\-]?\d{{7}})[\s\-]?[A-Za-z]{_END}")),
    ("id_number", "grouped", re.compile(rf"{_EDGE}[A-Za-z]\d{{2,4}}[\s\-]\d{{3,5}}[\s\-]\d{{3,5}}{_END}")),
    ("id_number", "serial", re.compile(rf"{_EDGE}[A-Za-z]{{1,2}}\s?\d{{6,8}}{_END}")),
    ("street_address", "number_first", re.compile(rf"{_EDGE}{_UNIT}\d{{1,5}}[a-z]?,?\s+(?:[^\W\d_][\w'’.\-]*\s+){{1,3}}{_SUFFIX}\b(?:\.(?=,|\s+[a-z(]))?{_UNIT_AFTER}{_TOWN}{_UNIT_AFTER}", re.I)),
    ("street_address", "type_first", re.compile(rf"{_EDGE}\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|allee|impasse|quai|cours|route|square)\s+(?:de\s+la\s+|de\s+l['’]\s?|des\s+|du\s+|de\s+|d['’]\s?)?[\w'’\-]+{_TOWN}", re.I)),
    ("street_address", "type_first_two", re.compile(rf"{_EDGE}\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|allee|impasse|quai|cours|route|square)\s+(?:de\s+la\s+|de\s+l['’]\s?|des\s+|du\s+|de\s+|d['’]\s?)[\w'’\-]+\s+[\w'’\-]+{_TOWN}", re.I)),
    ("street_address", "number_last", re.compile(rf"(?<!\w)(?:calle|c/|plaza|avenida|avda\.?|paseo|camino|carrera|via|viale|piazza|corso|rua)\s+(?:del\s+|de\s+la\s+|de\s+los\s+|de\s+las\s+|de\s+|della\s+|dei\s+|da\s+)?[\w'’\-]+(?:\s+[\w'’\-]+)?\s*,?\s*(?:n[.º°]\s*)?\d{{1,4}}(?:,?\s*\d{{1,2}}[º°ª]\s?\w?)?\b", re.I)),
    ("street_address", "compound", re.compile(r"(?<!\w)[^\W\d_][\w\-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ufer|damm|straat|gracht|laan)\s+\d{1,4}\s?[a-z]?(?!\w)", re.I)),
]
_STREET = frozenset(re.findall(r"\w+", _SUFFIX)) | frozenset("rue av bd chemin allée allee impasse quai cours route calle c plaza avenida avda paseo camino carrera via viale piazza corso rua".split())
_STREET_END = ("weg", "straße", "strasse", "str", "gasse", "platz", "allee", "ufer", "damm", "straat", "gracht", "laan")
_MOMENT = re.compile(r"\d{4}-\d\d-\d\d\W*|\d?\d:\d\d(?::\d\d)?\W*")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_PLACED = re.compile(r"\[(?:EMAIL|PHONE|ID_NUMBER|STREET_ADDRESS|PERSON_NAME|NAME|ADDRESS|URL)\]")

#: Words that are titles, or capitalised without being names, or cues before a kind of value.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam herr frau señor señora señorita sr sra srta don doña monsieur madame mademoiselle mme mlle".split())
CALENDAR = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember english french german spanish".split()
)
CUES = {
    "email": frozenset("mail e-mail email inbox write reach contact account reply-to send to at".split()),
    "phone": frozenset("phone call tel telephone fax voice mobile cell number text ring numéro nummer teléfono reach whatsapp on".split()),
    "id_number": frozenset("ssn security social insurance passport dni nie nino id identity national tax licence license no applicant file lists printed identification".split()),
    "street_address": frozenset("address live lives ship deliver pickup moved found parcel home house send bitte an visit at went".split()),
    "person_name": frozenset("name with from by to for regards thanks signed attn mr mrs ms dr ask saludo merci à sincerely cheers contact spoke named met saw de".split()),
}
NOT_PERSONAL = frozenset(
    "order lot model tracking voucher version extension ext ticket invoice ref reference code table gate locker room batch sku serial part item page coupon booking "
    "commande bestellung pedido raffle receipt isbn article build rated paid total kg cm".split()
)


class Roles(dict):
    """One letter per whitespace token (one per word of glued names and number words), remembered: what it could be part of. Emptied when full.

    p a proper word, t a title, i an initial, n a number word, s a street word, @ part of an address for mail, digits:
    1 up to two, 3 three to six, 7 more; a capital S is a street word that is also a proper word; dot: nothing.
    """

    def __init__(self, proper: Callable[[str], bool], room: int = 500_000) -> None:
        super().__init__()
        self.proper, self.room = proper, room

    def __missing__(self, token: str) -> str:
        if len(self) > self.room:
            self.clear()
        role = self[token] = self._role(token)
        return role

    def _role(self, token: str) -> str:
        low = token.lower()
        if "@" in low or "＠" in low or "(at)" in low or "[at]" in low or low in ("dot", "punkt", "punto", "point", "[dot]", "(dot)"):
            return "@"
        digits = sum(c.isdigit() for c in low)
        if digits:
            return "." if _MOMENT.fullmatch(token) else "1" if digits < 3 else "3" if digits < 7 else "7"
        m = _WORD.search(low)
        if not m:
            return "."
        parts = _WORD.findall(token)
        if len(parts) > 1 and _NAME_HINT.search(inside := "".join(map(self._role, parts))):
            return inside  # J.Smith, Dr.Smith
        numbers = re.split(r"[,\-]+", low.strip(",-.;:!?()\"'"))
        if len(numbers) > 1 and all(re.fullmatch(_DIGIT_WORD, x) for x in numbers):
            return "n" * len(numbers)
        word = m.group()
        if re.fullmatch(_DIGIT_WORD, word):
            return "n"
        if word in TITLES:
            return "t"
        if len(word) == 1 and token.strip("(\"'.,")[:1].isupper():
            return "i"
        known = word not in CALENDAR and (self.proper(word) or any(self.proper(w) for w in _WORD.findall(low)[1:]))
        if word in _STREET or word.endswith(_STREET_END):
            return "S" if known else "s"
        return "p" if known else "."


_NAME_HINT = re.compile(r"[ptiS][piS]")
_PHONE_HINT = re.compile(r"[37]|1[13]{2}|n{6}")  # no phone or id number has under six digits
_STREET_HINT = re.compile(r"[13].{0,8}[sS]|[sS].{0,7}[13]")
_AT_SIGN = re.compile(r"[\[(]\s?(?:at|@)\s?[\])]", re.I)


class Words:
    """A set of words as bits of their hashes, with remembered answers; emptied when full."""

    def __init__(self, bits: np.ndarray, room: int = 500_000) -> None:
        self.bits, self.room, self.seen = KeyBits(bits), room, {}

    def __contains__(self, word: object) -> bool:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > self.room:
                self.seen.clear()
            got = self.seen[word] = bool(self.bits.has(np.array([word_key(word)], dtype=np.uint64))[0])
        return got


def word_key(word: str) -> int:
    """The hash of a word that the engine's own hash function gives."""
    return xxhash.xxh64_intdigest(word, seed=42)


class Field:
    """Weights of the semi-Markov field and its decoding."""

    def __init__(self, weights: dict[str, float] | None = None, proper: Container[str] = (), known: Container[str] = (), brands: Container[str] = ()) -> None:
        self.w = defaultdict(float, weights or {})
        self.proper, self.known, self.brands = proper.__contains__, known, brands
        self.roles = Roles(self.proper)

    def candidates(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, family) of the segments that the field scores."""
        out = []
        hint = "".join(map(self.roles.__getitem__, text.split()))
        kinds = []
        if "@" in hint or _AT_SIGN.search(text):
            kinds.append("email")
        if _PHONE_HINT.search(hint):
            kinds += ["phone", "id_number"]
        if _STREET_HINT.search(hint):
            kinds.append("street_address")
        if kinds:
            for kind, family, pattern in FAMILIES:
                if kind in kinds:
                    out += [(m.start(), m.end(), kind, family) for m in pattern.finditer(text)]
        if _NAME_HINT.search(hint):
            out += self._name_segments(text)
        if out and "[" in text:
            placed = [m.span() for m in _PLACED.finditer(text)]
            out = [c for c in out if not any(a < c[1] and c[0] < b for a, b in placed)]
        return out

    def _name_segments(self, text: str) -> list[tuple[int, int, str, str]]:
        marks: list[tuple[int, int, str, str]] = []  # start, end, role, lower
        proper = self.proper
        for m in _WORD.finditer(text):
            word = m.group()
            low = word.lower()
            initial = len(word) == 1 and word.isupper() and (word != "I" or text[m.end() : m.end() + 1] == ".")  # else the pronoun
            role = "t" if low in TITLES else "i" if initial else "p" if proper(low) and low not in CALENDAR else ""
            if role:
                marks.append((m.start(), m.end(), role, low))
        out = []
        for i in range(len(marks)):
            roles = marks[i][2]
            for j in range(i + 1, min(i + NAME_TOKENS + 1, len(marks))):
                gap = text[marks[j - 1][1] : marks[j][0]]
                if not _joined(gap, marks[j - 1][2], roles, marks[j][2]):
                    break
                roles += "," if "," in gap else ""
                roles += marks[j][2]
                if j - i < NAME_TOKENS and roles[-1] == "p" and "p" in roles:
                    out.append((marks[i][0], marks[j][1], "person_name", roles))
                elif roles.endswith(",i") or roles.endswith("p,i") or roles == "pi":
                    out.append((marks[i][0], marks[j][1], "person_name", roles))
        return out

    def features(self, text: str, seg: tuple[int, int, str, str]) -> list[str]:
        a, b, kind, family = seg
        value = text[a:b]
        before = [x.lower() for x in _WORD.findall(text[max(0, a - 40) : a])[-3:]]
        after = _WORD.findall(text[b : b + 24])[:1]
        out = [f"{kind}|bias", f"{kind}|f={family}"]
        out += [f"{kind}|cue{i}" for i, x in enumerate(reversed(before)) if x in CUES[kind]]
        out += [f"{kind}|not{i}" for i, x in enumerate(reversed(before)) if x in NOT_PERSONAL and i < 2]
        if after and after[0].lower() in NOT_PERSONAL:
            out.append(f"{kind}|not_after")
        if kind == "person_name":
            low = re.sub(r"\s+", " ", value.lower())
            words = _WORD.findall(value)
            out.append(f"{kind}|case=" + ("U" if value.isupper() else "l" if value.islower() else "C" if all(w[0].isupper() for w in words) else "m"))
            if low in self.brands or low.replace(".", "") in self.brands or any(low.startswith(x + " ") or low.endswith(" " + x) for x in self.brands_of(words)):
                out.append(f"{kind}|brand")
            rare = sum(len(w) > 1 and w.lower() not in self.known and w.lower() not in TITLES for w in words)
            if rare:
                out.append(f"{kind}|rare{min(rare, 2)}")
            if re.search(r"\d[a-z]?,?\s+$", text[max(0, a - 6) : a]):
                out.append(f"{kind}|after_digit")
            if re.match(rf"\s+{_SUFFIX}\b", text[b : b + 14], re.I) or re.search(rf"\s{_SUFFIX}$", value, re.I) or (words[0].lower() not in TITLES and re.match(rf"{_SUFFIX}\b", value, re.I)):
                out.append(f"{kind}|street")
            if a and text[a - 1] in "@/_.#":
                out.append(f"{kind}|inside")
        else:
            digits = sum(c.isdigit() for c in value)
            out.append(f"{kind}|d={min(digits, 12)}")
            out.append(f"{kind}|f={family}|cue" if any(x in CUES[kind] for x in before) else f"{kind}|f={family}|nocue")
        out.append(f"{kind}|len={min(b - a, 60) // 6}")
        return out

    def brands_of(self, words: list[str]) -> list[str]:
        low = [w.lower() for w in words]
        return [p for p in (" ".join(low[i : i + 2]) for i in range(len(low) - 1)) if p in self.brands]

    def score(self, text: str, seg: tuple[int, int, str, str]) -> float:
        w = self.w
        return sum(w[f] for f in self.features(text, seg) if f in w)

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best set of disjoint typed segments: dynamic programming over segment ends, boundaries and types at once."""
        segs = self.candidates(text)
        if not segs:
            return []
        scored = sorted({(b, a, kind): s for a, b, kind, family in segs if (s := self.score(text, (a, b, kind, family))) > 0}.items())
        if not scored:
            return []
        ends = [e for (e, _, _), _ in scored]
        best, back = [0.0], [None]
        for n, ((b, a, kind), s) in enumerate(scored):
            lo = int(np.searchsorted(ends[:n], a, side="right")) if n else 0
            take = best[lo] + s
            if take > best[-1]:
                best.append(take)
                back.append((lo, (a, b, kind)))
            else:
                best.append(best[-1])
                back.append(None)
        out, n = [], len(scored)
        while n:
            if back[n] is None:
                n -= 1
            else:
                n, seg = back[n][0], back[n][1]
                out.append(seg)
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.2) -> None:
        """Gradient ascent on the conditional likelihood: forward-backward sums over all disjoint sets of candidates."""
        rng = random.Random(3)
        prepared = []
        for text, gold in examples:
            segs = sorted(self.candidates(text), key=lambda c: (c[1], c[0]))
            if segs:
                prepared.append((segs, [self.features(text, s) for s in segs], [(s[0], s[1], s[2]) in gold for s in segs]))
        for epoch in range(epochs):
            rng.shuffle(prepared)
            for segs, feats, gold in prepared:
                p = self._marginals(segs, [sum(self.w[f] for f in fs) for fs in feats])
                for fs, g, q in zip(feats, gold, p):
                    step = rate / (1 + 0.3 * epoch) * (float(g) - q)
                    if abs(step) > 1e-4:
                        for f in fs:
                            self.w[f] += step
        for f in list(self.w):
            self.w[f] = round(self.w[f], 4)

    @staticmethod
    def _marginals(segs: list[tuple[int, int, str, str]], scores: list[float]) -> list[float]:
        points = sorted({p for s in segs for p in s[:2]})
        at = {p: i for i, p in enumerate(points)}
        n = len(points)
        fwd, bwd = np.full(n, -np.inf), np.full(n, -np.inf)
        fwd[0] = bwd[-1] = 0.0
        into, outof = defaultdict(list), defaultdict(list)
        for s, v in zip(segs, scores):
            into[at[s[1]]].append((at[s[0]], v))
            outof[at[s[0]]].append((at[s[1]], v))
        for i in range(1, n):
            fwd[i] = np.logaddexp.reduce([fwd[i - 1], *(fwd[j] + v for j, v in into[i])])
        for i in range(n - 2, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[j] + v for j, v in outof[i])])
        return [float(np.exp(min(0.0, fwd[at[s[0]]] + v + bwd[at[s[1]]] - fwd[-1]))) for s, v in zip(segs, scores)]


def _joined(gap: str, role: str, so_far: str, following: str) -> bool:
    """Whether two name words may belong to one segment, given what stands between them."""
    if "\n" in gap or len(gap) > 4:
        return False
    mark = gap.strip()
    if not mark:
        return bool(gap) and following != "t"
    if mark == ".":
        return role in "ti" and following != "t"
    return mark == "," and role == "p" and "," not in so_far and len(so_far) == 1 and following in "pi"


# ---- training: the field is fitted on sentences made here, with decoys, in every spelling it should stand


def examples(seed: int = 11, n: int = 2500) -> list[tuple[str, list[tuple[int, int, str]], set[str], set[str]]]:
    """(text, gold segments, proper words, brands) of made-up sentences."""
    r = random.Random(seed)
    given = "Alda Berit Corwin Dagny Edric Farida Goran Hesper Ivo Jolanta Kofi Liesel Milo Noor Oskar Petra Quentin Rosalind Stefan Thea Umberto Vesna Wilmer Ximena Yusuf Zora".split()
    family = "Abernack Bordelwyn Castellory Drummock Eisenquell Fontayne Grovenor Hollingbrand Ironmoor Jaskulla Kirchwell Lambrecourt Mossgrave Nettlebury Orlandieu Pemberlin Quillfeather Rosenquist-Hale Sarnowitz Thistlebank".split()
    street = "Maple Birch Hollow|Stone Mill|Rosewood|Cedar Grange|Thornfield|Old Ferry|Willow|Granite Spring".split("|")
    suffix = "Street St Road Rd Avenue Ave Lane Drive Dr Court Close Place Way Terrace".split()
    town = "Brackwater Stonelyford Highmere Eastbourne".split()
    hosts = "birchmail.example tallowpost.test greyfen.mail.example ostlerbox.invalid".split()
    brand = ["edwin marrow", "clara thimble", "uncle barley", "dr pickle"]
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = "zero one two three four five six seven eight nine".split()

    def name() -> str:
        g, f = r.choice(given), r.choice(family)
        s = r.choice([f"{g} {f}", f"{g} {f}", f"{g} {r.choice('ABCDEFGHJKLM')}. {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{r.choice(['Dr.', 'Mrs.', 'Mr', 'Prof.', 'Ms.', 'Herr', 'Señora'])} {r.choice([g + ' ' + f, f])}", f"{g}  {f}", f"{g} {f[0]}."])
        s = s.rstrip(".") if s.endswith(".") else s
        return r.choice([s, s, s, s.upper(), s.lower()]) if len(s) > 12 else s

    def email() -> str:
        a, h = r.choice([f"{r.choice(given)}.{r.choice(family)}", f"{r.choice(given)}_{d(2)}", f"{r.choice(given)}+shop", r.choice(given)]).lower(), r.choice(hosts)
        return r.choice([f"{a}@{h}", f"{a}@{h}", f"{a}@{h}".upper(), f"{a}(at){h}", f"{a} [at] {h.replace('.', ' [dot] ')}", f"{a.replace('.', ' dot ')} at {h.replace('.', ' dot ')}", f"{a}＠{h}"])

    def phone() -> str:
        a, b, c = r.choice("2345689") + d(2), r.choice("2345689") + d(2), d(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{b}-{c}", f"+44 20 7946 0{d(3)}", f"+49 30 23125 {d(3)}", f"{' '.join(r.choice(words) for _ in range(3))}, {' '.join(r.choice(words) for _ in range(4))}"])

    def ident() -> tuple[str, str]:
        return r.choice([("SSN ", f"{d(3)}-{d(2)}-{d(4)}"), ("", f"{d(3)}-{d(2)}-{d(4)}"), ("SSN ", f"{d(3)} {d(2)} {d(4)}"), ("social security number ", d(9)), ("", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}"), ("DNI ", d(8) + r.choice("BDFGH")), ("passport no. ", "ZX" + d(7)), ("NIE ", "X" + d(7) + "L"), ("driver's license ", f"K{d(3)}-{d(4)}-{d(4)}")])

    def address() -> str:
        s = f"{r.randint(1, 4999)} {r.choice(street)} {r.choice(suffix)}"
        s = r.choice([s, s, f"Flat {r.randint(1, 40)}, {s}", f"{s}, {r.choice(town)} {d(5)}", f"{s}, Apt 4C", f"{r.randint(1, 90)} rue de la Vieille Tour", f"Calle del Sauce {r.randint(1, 99)}, 2º B", f"Plaza del Pozo {r.randint(1, 99)}", f"{r.choice(['Erlen', 'Tannenhof', 'Brunnen'])}weg {r.randint(1, 199)}", f"Gerberstraße {r.randint(1, 99)}"])
        return r.choice([s, s, s, s.upper(), s.lower()])

    frames = {
        "email": ["You can reach us under {}.", "Write to {} for the receipt.", "{} is my address for mail.", "Mail: {}", "Please answer {} today."],
        "phone": ["Call {} after six.", "My number is {}.", "Fax: {}.", "(mobile {})", "{} is the line to my desk.", "Text {} first.", "phone {}"],
        "id_number": ["They wanted my ID: {}.", "The form says {}.", "Insurance asked for {}.", "{} was printed for all to see.", "For the file: {}."],
        "street_address": ["I live at {}.", "Deliver: {} The rest follows.", "Moved to {} in spring.", "They sent {} Nothing came.", "Ship it to {} please.", "The parcel went to {}.", "They never found {}.", "Bitte an {} liefern.", "Our house is {}."],
        "person_name": ["I spoke with {} about it.", "Regards, {}", "Booked under the name {}.", "{} signed for it.", "From: {}", "Thanks to {} for the help.", "Merci à {} pour tout.", "a clerk called {} took it."],
    }
    decoys = [
        lambda: f"Order {d(4)}-{d(5)}-{d(3)} came.", lambda: f"lot {d(7)} is best.", lambda: f"Model {r.choice(['AB', 'QT'])}-{d(6)} works.", lambda: f"They wanted voucher CD-{d(2)}-{d(2)}.", lambda: f"order {d(2)}-{d(2)}-{d(4)}",
        lambda: f"order {d(3)}-{d(2)}-{d(4)} is late", lambda: f"extension {d(2)}", lambda: f"Tracking code {d(10)} never moved.", lambda: f"tracking {d(9)}", lambda: f"Version {d(1)}.{d(2)}.{d(1)} with {d(3)} reviews.", lambda: f"lot {d(10)}",
        lambda: f"I like the {r.choice(brand).title()} range.", lambda: f"The {r.choice(brand).title()} kettle is fine.", lambda: f"Seen on {r.randint(2015, 2026)}-{r.randint(10, 12)}-{r.randint(10, 28)} at 12:30.", lambda: f"Paid ${d(1)},{d(3)}.50 in total.",
        lambda: f"It weighs {d(2)}.{d(2)} kg and measures {d(2)} x {d(2)} cm.", lambda: f"Follow @{r.choice(family).lower()} for offers.", lambda: f"Take gate {d(1)} or table {d(2)} at the court.", lambda: "I drive 20 minutes a day on the close road.",
        lambda: f"We went to {r.choice(town)} with {r.choice(given)} and a friend.", lambda: f"serial ZX{d(7)}", lambda: f"voucher {d(8)}B", lambda: f"invoice {d(3)}-{d(4)}", lambda: f"ref {d(3)}-{d(3)}-{d(4)}",
    ]
    proper = {w.lower() for w in given + family + town + suffix} | set("about signed today please our merci".split()) | {w.lower() for x in street for w in x.split()} | {p for b in brand for p in b.split()} | {p for w in family for p in [w.lower()]}
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.4:
                text += r.choice(decoys)() + " "
                continue
            kind = r.choice(KINDS)
            lead = ""
            value = {"email": email, "phone": phone, "street_address": address, "person_name": name}[kind]() if kind != "id_number" else ""
            if kind == "id_number":
                lead, value = ident()
            left, right = r.choice(frames[kind]).split("{}")
            a = len(text) + len(left) + len(lead)
            text += left + lead + value + right + r.choice([" ", "\n"])
            gold.append((a, a + len(value), kind))
        out.append((text, gold, proper, set(brand)))
    return out


@lru_cache(maxsize=1)
def trained_weights() -> dict[str, float]:
    """Weights of the field, fitted on the made-up sentences; takes a few seconds, the same result each time."""
    made = examples()
    seldom = random.Random(7)
    field = Field({}, made[0][2], {w for w in sorted(made[0][2]) if seldom.random() < 0.7}, frozenset(made[0][3]))
    field.fit([(t, g) for t, g, _, _ in made])
    return {k: v for k, v in field.w.items() if v}


# ---- the corpus side


def proper_words(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the proper words, written with a capital often enough where they stand inside a sentence, counted over all
    texts, and of those among them that are well known."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        every: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                toks = t.split()
                every.update(toks)
                seen.update([y for x, y in zip(toks, toks[1:]) if x[-1] not in ".!?:>•*-…"])
            if len(every) > 1_500_000:
                yield _cased(seen, every)
                seen, every = Counter(), Counter()
        yield _cased(seen, every)

    stats = texts.select("text").mapInPandas(count, "word string, n bigint, upper bigint, every bigint").groupBy("word")
    stats = stats.agg(F.sum("n").alias("n"), F.sum("upper").alias("u"), F.sum("every").alias("e"))
    hits = stats.filter((F.col("u") >= 1) & (F.col("u") >= PROPER_SHARE * F.col("n")) & (F.col("n") >= INNER_SHARE * F.col("e")) & (F.length("word") > 1))
    hits = cut(hits.select(F.xxhash64("word").alias("key"), (F.col("u") >= KNOWN).alias("known")), "pii")
    return key_bits(hits.select("key"), 48), key_bits(hits.filter("known").select("key"), 48)


def _cased(seen: Counter[str], every: Counter[str]) -> pd.DataFrame:
    """Per lower-case word: how often inside a sentence, how often so with a capital, how often in all."""
    n: Counter[str] = Counter()
    up: Counter[str] = Counter()
    full: Counter[str] = Counter()
    for token, k in every.items():
        m = _WORD.search(token)
        if not m or len(m.group()) != len(token.strip(".,;:!?\"'()[]{}<>…“”‘’«»*_")):
            continue
        word = m.group()
        if word.isupper() and len(word) > 1:
            continue
        low, inner = word.lower(), seen.get(token, 0)
        full[low] += k
        n[low] += inner
        if word[0].isupper():
            up[low] += inner
    return pd.DataFrame([(w, n[w], up[w], k) for w, k in full.items()], columns=["word", "n", "upper", "every"])


def brand_names(items: DataFrame, name: str = "name") -> np.ndarray:
    """Bits of the leading word pairs (and titled pairs) that at least five item names share, lower case: brands, not persons.

    All such pairs are in it, however many there are; one name in 5,000 passes for a brand wrongly up to 5 million brands,
    more beyond, since the bits have a bound.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(name)), r"[^\p{L}\p{N}'&\-]+", " ")), " ")
    rows = items.filter(F.col(name).isNotNull()).select(words.alias("w")).filter(F.size("w") >= 3).select(F.concat_ws(" ", F.slice("w", 1, 2)).alias("p"))
    return key_bits(rows.groupBy("p").agg(F.count("*").alias("n")).filter("n >= 5").select(F.xxhash64("p").alias("key")), 48)


def find_personal(texts: DataFrame, brands: np.ndarray, redacted: bool = False) -> DataFrame:
    """Personal values in (tbl, row_key, text): rows (tbl, row_key, kind, start, length), or with ``redacted`` (tbl, row_key, text).

    Proper words are counted over all texts, one place with a capital makes a word a candidate, and shared as bits of
    bounded size; then each text's candidate segments are scored by whole-span features, among them how well known the
    words are, and one dynamic program chooses boundaries and types together.

    Defined results: null and empty texts hold nothing (redacted: they are kept as they are); placeholders are no
    values; a value is replaced by its kind's placeholder and everything else stays byte for byte; repeated rows are
    treated alike; an empty table gives no rows; texts of any length are read whole.
    """
    spark = texts.sparkSession
    full = spread(texts.select("tbl", "row_key", "text"), "row_key")
    shared = spark.sparkContext.broadcast((trained_weights(), *proper_words(full.filter("text is not null")), brands))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, *bits = shared.value
        field = Field(weights, *map(Words, bits))
        for b in batches:
            if redacted:
                yield b.assign(text=[redact(t, field.decode(t)) if t else t for t in b["text"]])
                continue
            out = [(tbl, k, kind, a, z - a) for tbl, k, t in zip(b["tbl"], b["row_key"], b["text"]) if t for a, z, kind in field.decode(t)]
            yield pd.DataFrame(out, columns=["tbl", "row_key", "kind", "start", "length"])

    return full.mapInPandas(run, "tbl string, row_key string, text string" if redacted else "tbl string, row_key string, kind string, start int, length int")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])
