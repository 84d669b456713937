"""Releasing texts: rule detectors with protected phrases, pseudonyms that keep a name's shape, consistent replacement, contract checks."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.text import anchor_contract, check_key

#: Shapes of the values that rules can tell, and words that precede a name.
RULES: dict[str, str] = {
    "email": r"\b[\w.+'-]+@[\w-]+(?:\.[\w-]+)+\b",
    "phone": r"(?:(?<!\w)\+?1[\s.-]?)?(?:\(\d{3}\)\s?|(?<!\d)\d{3}[\s.-])\d{3}[\s.-]\d{4}(?!\d)",
    "url": r"(?i:(?:https?://|ftp://|www\.)[^\s<>\"')\]]*[^\s<>\"')\].,;:!?])",
    "street_address": r"\b\d{1,5}[ \t]+(?:[A-Z][a-z]+[ \t]+){1,3}(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|Ct|Court|Pl|Place|Hwy|Highway|Pkwy|Parkway)\b\.?",
    "person_name": r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?[ \t]+[A-Z][a-z]{2,}(?:[ \t]+[A-Z][a-z]{2,})?\b",
}
_TITLE = re.compile(r"^(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?$")


def given_name_rule(given: Sequence[str]) -> str:
    """A rule for a given name of the list followed by a capitalised word."""
    return r"\b(?:" + "|".join(map(re.escape, sorted(given))) + r")[ \t]+[A-Z][a-z]{2,}(?:-[A-Z][a-z]{2,})?\b"


def spans_of(text: str, rules: Sequence[tuple[str, re.Pattern[str]]], protected: Iterable[str] = (), allowed: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of disjoint hits, leftmost first, of those the longest; none inside a protected phrase or on the allow list.

    Protected phrases of three characters or more count at all their places, overlapping ones too.
    """
    shields = []
    for phrase in protected:
        at = text.find(phrase) if len(phrase) > 2 else -1
        while at >= 0:
            shields.append((at, at + len(phrase)))
            at = text.find(phrase, at + 1)
    hits = sorted((m.start(), -m.end(), kind) for kind, p in rules for m in p.finditer(text) if m.group() not in allowed)
    out, until = [], -1
    for a, z, kind in hits:
        if a >= until and not any(s <= a and -z <= e for s, e in shields):
            out.append((kind, a, -z))
            until = -z
    return out


def find_spans(df: DataFrame, key: str, text: str, protected: str | None = None, given: Sequence[str] = (), allowed: frozenset[str] = frozenset()) -> DataFrame:
    """(key, kind, start, end, value) of every hit; ``protected`` names an array column of phrases. Null texts have none."""
    shapes = [*RULES.items(), *([("person_name", given_name_rule(given))] if given else [])]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = [(k, re.compile(p)) for k, p in shapes]
        for b in batches:
            out = [(k, kind, a, z, t[a:z]) for k, t, p in zip(b["k"], b["t"], b["p"]) for kind, a, z in spans_of(t, rules, p if p is not None else (), allowed)]
            yield pd.DataFrame(out, columns=["key", "kind", "start", "end", "value"])

    shield = F.col(protected) if protected else F.lit(None).cast("array<string>")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), shield.alias("p")).filter("t is not null")
    return rows.mapInPandas(run, f"key {rows.schema['k'].dataType.simpleString()}, kind string, start int, end int, value string")


def spans_tally(spans: DataFrame) -> DataFrame:
    """(kind, hits, values, texts): places, different values, and texts that have one."""
    return spans.groupBy("kind").agg(F.count("*").alias("hits"), F.count_distinct("value").alias("values"), F.count_distinct("key").alias("texts"))


def pseudonym(name: str, key_hex: str, given: Sequence[str], family: Sequence[str]) -> str:
    """A made-up name of the same shape: titles stay, one given name and one family name stand for each real one, everywhere."""
    key = check_key(key_hex)
    pick = lambda word, names: names[int.from_bytes(hmac.new(key, word.lower().encode(), hashlib.sha256).digest()[:8], "big") % len(names)]
    words = name.split()
    out = [w for w in words if _TITLE.match(w)]
    rest = words[len(out) :]
    if len(rest) > 1:
        out.append(pick(rest[0], given))
    return " ".join([*out, pick(rest[-1], family)]) if rest else name


def substitute(text: str, table: dict[str, str]) -> str:
    """All keys replaced at once, the longest first, only where they are no part of a longer word."""
    if not text or not table:
        return text
    edge = lambda k: (r"(?<![A-Za-z0-9])" if k[:1].isalnum() else "") + re.escape(k) + (r"(?![A-Za-z0-9])" if k[-1:].isalnum() else "")
    pattern = re.compile("|".join(map(edge, sorted(table, key=lambda k: (-len(k), k)))))
    return pattern.sub(lambda m: table[m.group()], text)


def released(df: DataFrame, key: str, text: str, required: str, protected: str, secret: str, given: Sequence[str], family: Sequence[str], known: Sequence[str] = ()) -> DataFrame:
    """(key, text, required, replaced, broken): each record's text and anchors with its personal values replaced alike.

    Names become pseudonyms, other values their typed mark. ``broken`` is why the new text breaks the contract of the new
    anchors, null where it keeps it. Values inside the protected phrases of the record stay.
    """
    shapes = [*RULES.items(), *([("person_name", given_name_rule(known))] if known else [])]
    ours = frozenset(f"{g} {f}" for g in given for f in family)  # a pseudonym is not replaced again

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = [(k, re.compile(p)) for k, p in shapes]
        for b in batches:
            out = []
            for k, t, need, keep in zip(b["k"], b["t"], b["need"], b["keep"]):
                need = list(need) if need is not None else []
                found = spans_of(t, rules, keep if keep is not None else (), ours) if t else []
                swap = {t[a:z]: pseudonym(t[a:z], secret, given, family) if kind == "person_name" else f"[{kind.upper()}]" for kind, a, z in found}
                out.append((k, substitute(t, swap), [substitute(x, swap) for x in need], len(swap)))
            yield pd.DataFrame(out, columns=["k", "text", "required", "replaced"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(required).alias("need"), F.col(protected).alias("keep"))
    done = rows.mapInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, text string, required array<string>, replaced int")
    return done.select(F.col("k").alias(key), "text", "required", "replaced", anchor_contract("text", "required", F.array().cast("array<string>")).alias("broken"))
