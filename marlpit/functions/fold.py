"""Folding of text for comparison: letter case, character forms, look-alikes, markup entities, invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

#: Cyrillic and Greek letters that look like a Latin one.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнАЕОРСУХІЈЅКМТВНαονιρτυχκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhlkmtbnAEOPCYXIJSKMTBNaoviptuxkABEZHIKMNOPTYX",
)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_MARKS = re.compile("[̀-ͯ]")
_WORD = re.compile(r"\w+(?:['’\-‐‑]\w+)*")


def fold(text: str) -> str:
    """Lower-case text with NFKC forms, entities resolved, invisible characters dropped, look-alikes and accents folded."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    text = _INVISIBLE.sub("", text).translate(LOOKALIKES).lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """Folded words; inner hyphens and apostrophes stay inside a word but do not count (``re-use`` equals ``reuse``)."""
    if not text:
        return []
    return [w.replace("-", "").replace("'", "").replace("’", "").replace("‐", "").replace("‑", "") if not w.isalnum() else w for w in _WORD.findall(fold(text))]
