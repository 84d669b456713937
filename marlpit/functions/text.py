"""Column expressions for text, dates, money, options and labels. Every one is Column to Column and stays in the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- clipping, joining, labels


def squeeze(text: ColumnOrName) -> Column:
    """Runs of blanks of any kind become one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def clip(text: ColumnOrName, limit: int) -> Column:
    """Trimmed text; a longer one keeps ``limit - 1`` characters without trailing blanks and ends in ``…``. Null gives ``''``."""
    t = F.trim(F.coalesce(_c(text), F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def clip_words(text: ColumnOrName, limit: int) -> Column:
    """Trimmed text; a longer one is squeezed and, if still too long, cut at the last space before ``limit`` and marked ``[...]``."""
    t = F.trim(_c(text))
    flat = squeeze(text)
    head = F.substring(flat, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(t) <= limit, t).when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit(" [...]")))


def merge_title(title: ColumnOrName, body: ColumnOrName, slack: int = 5) -> Column:
    """``title`` on a line of its own before ``body``, unless the body begins with it (any case, ``slack`` characters later at most)."""
    t, b = F.trim(F.coalesce(_c(title), F.lit(""))), F.trim(F.coalesce(_c(body), F.lit("")))
    repeated = F.contains(F.lower(F.substring(b, F.lit(1), F.length(t) + slack)), F.lower(t))
    return F.when((t == "") | repeated, b).otherwise(F.concat_ws("\n", t, F.nullif(b, F.lit(""))))


def category_label(category: ColumnOrName) -> Column:
    return squeeze(F.translate(_c(category), "_", " "))


def clip_each(values: ColumnOrName, most: int, limit: int) -> Column:
    """The first ``most`` elements, each clipped; null gives an empty array."""
    return F.transform(F.slice(F.coalesce(_c(values), F.array().cast("array<string>")), 1, most), lambda v: clip(v, limit))


def join_clip(values: ColumnOrName, limit: int, sep: str = " ") -> Column:
    return clip(F.concat_ws(sep, _c(values)), limit)


def short_values(values: ColumnOrName, limit: int = 200) -> Column:
    """The entries of a map<string,string> whose value is set and at most ``limit`` characters long."""
    return F.map_filter(_c(values), lambda k, v: v.isNotNull() & (F.length(v) <= limit))


def scalar_entries(details: ColumnOrName, limit: int = 200) -> Column:
    """Of a JSON object those entries whose value is a text or a number of at most ``limit`` characters; an empty map for anything else."""
    m = F.from_json(_c(details), "map<string,string>", {"mode": "PERMISSIVE"})
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & (F.length(v) <= limit) & ~v.rlike(r"^\s*[\[{]") & ~v.isin("true", "false"))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def describe(name: ColumnOrName, category: ColumnOrName, city: ColumnOrName) -> Column:
    """``name (category, city)``, without the city where there is none."""
    where = F.when(F.coalesce(_c(city), F.lit("")) != "", F.concat(F.lit(", "), _c(city))).otherwise(F.lit(""))
    return F.concat(_c(name), F.lit(" ("), category_label(category), where, F.lit(")"))


# ---- dates, numbers, places


def iso_from_millis(ms: ColumnOrName) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: ColumnOrName) -> Column:
    """The instant of an ISO text with ``Z`` or an offset; null where it is none."""
    return F.try_to_timestamp(_c(text))


def minute(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm")


def between_stamps(first: ColumnOrName, last: ColumnOrName, unit: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """The day between two instants at the share ``low + unit * (high - low)`` of the way."""
    a, b = F.unix_micros(_c(first)), F.unix_micros(_c(last))
    return F.to_date(F.timestamp_micros((a + (b - a) * (low + unit * (high - low))).cast("bigint")))


def number_or_null(text: ColumnOrName, kind: str = "double") -> Column:
    """A number written in digits; null for anything else (also ``1.5d``, which a cast would take)."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast(kind))


def parse_price(text: ColumnOrName) -> Column:
    """A positive, finite price without ``$`` and thousands commas; null otherwise."""
    v = number_or_null(F.translate(_c(text), "$,", ""))
    return F.when((v > 0) & (v < float("inf")), v)


def sign_level(text: ColumnOrName) -> Column:
    """The price level that a text of dollar signs alone states."""
    return F.when(_c(text).rlike(r"^\$+$"), F.length(_c(text)))


def city_of_address(address: ColumnOrName) -> Column:
    """The second last of at least three parts between commas."""
    parts = F.split(_c(address), ",")
    return F.when(F.size(parts) >= 3, F.nullif(F.trim(F.try_element_at(parts, F.lit(-2))), F.lit("")))


def money(amount: ColumnOrName, cents: bool = True) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(amount), 2 if cents else 0))


def matching(values: ColumnOrName, include: str, exclude: str) -> Column:
    """The elements that match ``include`` and not ``exclude``, in any letter case."""
    return F.filter(_c(values), lambda v: v.rlike(f"(?i){include}") & ~v.rlike(f"(?i){exclude}"))


def is_airport_code(text: ColumnOrName) -> Column:
    return F.coalesce(_c(text).rlike(r"^\p{Lu}{3}$"), F.lit(False))


def tokens_about(text: ColumnOrName, chars: int = 4) -> Column:
    return F.floor(F.length(_c(text)) / chars)


def suffix_index(key: ColumnOrName, sep: str = "/") -> Column:
    """The whole number after the last ``sep`` of an id; null without one."""
    return F.try_element_at(F.split(_c(key), sep), F.lit(-1)).try_cast("int")


def nearness(price_a: ColumnOrName, price_b: ColumnOrName, pop_a: ColumnOrName, pop_b: ColumnOrName, level_a: ColumnOrName, level_b: ColumnOrName) -> Column:
    """Distance of two items: log prices and log popularities; where a price is missing 0.7 per level; 1 if incomparable."""
    gap = lambda a, b: F.abs(F.log1p(_c(a)) - F.log1p(_c(b)))
    levels = 0.7 * F.abs(_c(level_a) - _c(level_b))
    return F.coalesce(gap(price_a, price_b), levels, F.lit(1.0)) + F.coalesce(gap(pop_a, pop_b), F.lit(0.0))


# ---- options, labels, probabilities


def option_text(name: ColumnOrName, desc: ColumnOrName) -> Column:
    return F.concat_ws(": ", _c(name), F.nullif(F.coalesce(_c(desc), F.lit("")), F.lit("")))


def option_labels(kind: ColumnOrName, n: Column) -> Column:
    """Labels that stand for ``n`` options: A..Z, AA.. for a choice, yes and no for a yes-or-no, digits for a score of up to ten levels."""
    letter = lambda i: F.char(F.lit(65) + i.cast("bigint"))
    letters = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26))))
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string"))
    return F.when(_c(kind) == "choice", letters).when(_c(kind) == "noul", F.array(F.lit("yes"), F.lit("no"))).when(n <= 10, digits)


def defang(text: ColumnOrName) -> Column:
    """Control tokens ``<|x|>`` lose their bars, so that a text cannot give commands to a chat template."""
    return F.regexp_replace(_c(text), r"<\|([^|>]*)\|>", "<¦$1¦>")


def first_argmax(values: ColumnOrName) -> Column:
    """Position, from 0, of the first largest element."""
    return (F.array_position(_c(values), F.array_max(_c(values))) - 1).cast("int")


def tied(values: ColumnOrName, within: float = 1e-9) -> Column:
    """Whether more than one element lies within ``within`` of the largest."""
    v = _c(values)
    return F.size(F.filter(v, lambda x: x >= F.array_max(v) - within)) > 1


def total(values: ColumnOrName) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda a, x: a + x)


def softmax(logits: ColumnOrName, temperature: float = 1.0) -> Column:
    """Probabilities at a temperature, shifted by the largest logit."""
    if not 0 < temperature < float("inf"):
        raise ValueError("the temperature must be finite and positive")
    z = _c(logits)
    e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature))
    return F.transform(e, lambda x: x / total(e))


def uniform_logits(n: Column) -> Column:
    """Equal log-probabilities for ``n`` options of a question that cannot be scored."""
    return F.array_repeat(-F.log(n.cast("double")), n.cast("int"))


def floored_logs(probs: ColumnOrName, floor: float = 1e-9) -> Column:
    """Logs of the shares of the probabilities, none below ``floor``, made to sum to one again."""
    p = _c(probs)
    up = F.transform(p, lambda x: F.greatest(x / total(p), F.lit(floor)))
    return F.transform(up, lambda x: F.log(x / total(up)))


def resolve_option(answer: ColumnOrName, keys: ColumnOrName) -> Column:
    """The option key an answer names: the key itself, or a text that begins with one key and a colon; null if none or several do."""
    a = F.trim(_c(answer))
    hits = F.filter(_c(keys), lambda k: (a == k) | a.startswith(F.concat(k, F.lit(": "))))
    return F.when(F.array_contains(_c(keys), a), a).when(F.size(hits) == 1, F.get(hits, 0))


def fenced_json(reply: ColumnOrName, schema: str) -> Column:
    """The JSON object of a reply, with or without a code fence around it; null where there is none."""
    inside = F.regexp_extract(_c(reply), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(_c(reply), r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(F.when(inside != "", inside).otherwise(bare), F.lit("")), schema)


# ---- masks, keys, anchors, evidence


def mask(text: ColumnOrName) -> Column:
    """The first letter or digit of each word, ``*`` for the others; everything else stays."""
    return F.regexp_replace(_c(text), r"(?<=[\p{L}\p{N}])[\p{L}\p{N}]", "*")


def hmac_sha256(message: ColumnOrName, key_hex: str) -> Column:
    """Keyed digest in hex. The key has at least 32 and at most 128 hex digits."""
    key = check_key(key_hex)
    block = key + bytes(64 - len(key))
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    once = F.sha2(F.concat(F.unhex(F.lit(inner)), _c(message).cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(once)), 256)


def check_key(key_hex: str) -> bytes:
    """The bytes of a secret key, refused when it is too short to be one."""
    if len(key_hex) < 32 or len(key_hex) > 128:
        raise ValueError("a key has 32 to 128 hex digits")
    return bytes.fromhex(key_hex)


#: Typographic quotes, dashes and spaces and what they stand for.
_TYPOGRAPHY = "‘’“”–—   ", "''\"\"--   "


def plain_typography(text: ColumnOrName) -> Column:
    return squeeze(F.translate(_c(text), *_TYPOGRAPHY))


def anchor_pattern(anchor: ColumnOrName) -> Column:
    """A pattern that finds the anchor verbatim, not as a part of a longer word or number."""
    a = plain_typography(anchor)
    start = F.when(a.rlike(r"^[\p{L}\p{N}]"), F.lit("(?<![A-Za-z0-9])")).otherwise(F.lit(""))
    end = F.when(a.rlike(r"[\p{L}\p{N}]$"), F.lit(r"(?![A-Za-z0-9]|[.,]\d)")).otherwise(F.lit(""))
    return F.concat(start, F.lit(r"\Q"), F.replace(a, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), end)


def holds_anchor(flat: Column, anchor: Column) -> Column:
    """Whether a text of plain typography holds the anchor; a blank anchor is held by every text."""
    return F.when(F.trim(anchor) == "", F.lit(True)).otherwise(F.rlike(flat, anchor_pattern(anchor)))


def missing_anchors(text: ColumnOrName, required: ColumnOrName) -> Column:
    flat = plain_typography(text)
    return F.filter(_c(required), lambda a: ~holds_anchor(flat, a))


def anchor_contract(text: ColumnOrName, required: ColumnOrName, forbidden: ColumnOrName) -> Column:
    """Why a text breaks its contract; null when it keeps it."""
    flat = plain_typography(text)
    broken = F.exists(_c(required), lambda a: ~holds_anchor(flat, a))
    wrong = F.exists(_c(forbidden), lambda a: holds_anchor(flat, a))
    return F.when(broken, F.lit("missing_required_anchor")).when(wrong, F.lit("forbidden_anchor_present"))


def evidence_span(text: ColumnOrName, least: int = 12, most: int = 200) -> Column:
    """The first sentence of ``least`` to ``most`` characters, else an opening cut at a word, else ``''``."""
    t = F.trim(F.coalesce(_c(text), F.lit("")))
    sentences = F.transform(F.regexp_extract_all(t, F.lit(r"[^.!?\n]+[.!?]?"), 0), lambda s: F.trim(s))
    fit = F.get(F.filter(sentences, lambda s: F.length(s).between(least, most)), 0)
    head = F.substring(t, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.length(t) > most) & (F.instr(head, " ") > 0) & (at >= least), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.coalesce(fit, cut)


def verified_evidence(text: ColumnOrName, evidence: ColumnOrName, least: int = 12, most: int = 200) -> Column:
    """The trimmed evidence when it stands in the text verbatim and has a fair length; null otherwise."""
    e = F.trim(_c(evidence))
    return F.when(F.length(e).between(least, most) & F.contains(_c(text), e), e)


#: The five replacements of the mail and review scrub, in their order.
SCRUB = (
    (r"(?i)(?:https?:/{1,2}|ftp://|www\.)[^\s<>\"')\]]+", "[URL]"),
    (r"(?U)\b[A-Z][\w.' -]{1,40}(?:/[\w-]{2,15})+@[\w-]{2,20}", "[EMAIL]"),
    (r"(?U)[\w.+'-]*@[\w-]+(?:\.[\w-]+)*|[\w.+'-]+@", "[EMAIL]"),
    (r"(?U)(?:\b[A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,3}|\[EMAIL\]>?\]?)\s*@\s*[A-Z][A-Za-z_]{1,20}\b", "[EMAIL]"),
    (r"(?U)(?:(?<!\w)\+?1[\s.-]?)?(?:\(\d{3}\)\s?|(?<!\d)\d{3}[\s.-])\d{3}[\s.-]\d{4}(?!\d)|(?<![\d-])(?:\d{3}|\d)-\d{4}(?![\d-])", "[PHONE]"),
)


def scrub(text: ColumnOrName) -> Column:
    """Addresses of the web and of mail, and phone numbers, replaced by typed marks; the order of the five rules matters."""
    out = _c(text)
    for pattern, mark in SCRUB:
        out = F.regexp_replace(out, pattern, mark)
    return out
