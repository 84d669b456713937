"""Queries of the text, date, option and label expressions over the data tables, with SQL written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions import text as tx
from marlpit.functions.ids import canonical_user, hash_unit
from marlpit.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = "00112233445566778899aabbccddeeff"  # a key of the tests; a release reads its own


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_WS = r"[\s\x0b\x{85}\p{Z}]+"
_UID = "nullif(lower(regexp_replace({}, '[\\s\\-]+', '', 'g')), '')"


@query(rf"""SELECT doc_id, CASE WHEN length(t) <= 60 THEN t WHEN length(f) <= 60 THEN f ELSE CASE WHEN length(h) - position(' ' IN reverse(h)) > 0 AND position(' ' IN h) > 0 THEN substr(h, 1, length(h) - position(' ' IN reverse(h))) ELSE h END || ' [...]' END AS clipped
FROM (SELECT doc_id, trim(text, ' ') AS t, trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ') AS f, substr(trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' '), 1, 60) AS h FROM documents) x""")
def text_clip_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clip_words("text", 60).alias("clipped"))


@query("""SELECT email_id, CASE WHEN s = '' OR contains(lower(substr(b, 1, length(s) + 5)), lower(s)) THEN b WHEN b = '' THEN s ELSE s || chr(10) || b END AS merged
FROM (SELECT email_id, trim(coalesce(subject, ''), ' ') AS s, trim(coalesce(body, ''), ' ') AS b FROM emails) x""")
def text_merge_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "emails").select("email_id", tx.merge_title("subject", "body").alias("merged"))


@query("""SELECT row_id, strftime(make_timestamp(epoch_ms(received_at) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS received, strftime(try_strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M') AS decided,
CAST(floor((epoch_us(received_at) - epoch_us(try_strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ'))) / 86400000000) AS BIGINT) AS days_late FROM interactions""")
def text_dates(spark: SparkSession, d: str) -> DataFrame:
    """Epoch milliseconds to ISO, ISO to instants and minutes, and spans in days."""
    i = table(spark, d, "interactions")
    at = tx.parse_iso("timestamp")
    late = F.floor((F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(at)) / F.lit(86_400_000_000)).cast("bigint")
    return i.select("row_id", tx.iso_from_millis(F.unix_millis(F.col("received_at").cast("timestamp"))).alias("received"), tx.minute(at).alias("decided"), late.alias("days_late"))


@query("""WITH u AS (SELECT user_id, min(received_at) AS a, max(received_at) AS b FROM interactions WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, CAST(make_timestamp(CAST(trunc(epoch_us(a) + (epoch_us(b) - epoch_us(a)) * (0.2 + CAST(('0x' || substr(sha256('update:' || user_id), 1, 13)) AS BIGINT) / 4503599627370496.0 * (0.8 - 0.2))) AS BIGINT)) AS DATE)::VARCHAR AS day FROM u""")
def text_day_between(spark: SparkSession, d: str) -> DataFrame:
    """A day between the first and the last row of each user, at a hashed share from 20 to 80 percent of the way."""
    u = table(spark, d, "interactions").filter("user_id is not null").groupBy("user_id").agg(F.min("received_at").cast("timestamp").alias("a"), F.max("received_at").cast("timestamp").alias("b"))
    return u.select("user_id", tx.between_stamps("a", "b", hash_unit(F.lit("update"), "user_id")).cast("string").alias("day"))


@query("""SELECT item_id, CASE WHEN price > 0 THEN price END AS price, price_level AS level, '$' || format('{:,.2f}', price) AS shown FROM items""")
def text_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices from their written form and back, levels from dollar signs."""
    i = table(spark, d, "items").withColumn("written", tx.money("price")).withColumn("signs", F.when(F.col("price_level") > 0, F.repeat(F.lit("$"), F.col("price_level"))))
    return i.select("item_id", tx.parse_price("written").alias("price"), tx.sign_level("signs").cast("int").alias("level"), F.col("written").alias("shown"))


@query("""SELECT item_id, CASE WHEN city LIKE '%,%' THEN trim(list_extract(string_split(city, ','), -1), ' ') ELSE nullif(trim(city, ' '), '') END AS city, NOT (contains(category, ',')) AND length(category) = 3 AND upper(category) = category AS code FROM items WHERE city IS NOT NULL""")
def text_cities(spark: SparkSession, d: str) -> DataFrame:
    """The city of an address written as name, city and category between commas."""
    i = table(spark, d, "items").filter("city is not null")
    address = F.concat_ws(", ", "name", "city", F.translate("category", ",", ";"))
    return i.select("item_id", tx.city_of_address(address).alias("city"), tx.is_airport_code("category").alias("code"))


@query(r"""SELECT item_id, trim(regexp_replace(replace(category, '_', ' '), '\s+', ' ', 'g'), ' ') AS label, list_extract(p, -1) AS last_part, len(list_filter(p, lambda v: regexp_matches(v, '(?i)and|food|snack') AND NOT regexp_matches(v, '(?i)baby'))) AS n_kept,
array_to_string(list_transform(p[1:2], lambda v: CASE WHEN length(v) <= 5 THEN v ELSE rtrim(substr(v, 1, 4), ' ') || '…' END), '|') AS short FROM (SELECT item_id, category, string_split(category, '_') AS p FROM items WHERE category IS NOT NULL) x""")
def text_categories(spark: SparkSession, d: str) -> DataFrame:
    """Category labels, the most specific part, parts chosen by patterns, and the first parts clipped."""
    i = table(spark, d, "items").filter("category is not null").withColumn("p", F.split("category", "_"))
    return i.select(
        "item_id", tx.category_label("category").alias("label"), F.try_element_at("p", F.lit(-1)).alias("last_part"),
        F.size(tx.matching("p", "and|food|snack", "baby")).cast("bigint").alias("n_kept"), F.concat_ws("|", tx.clip_each("p", 2, 5)).alias("short"),
    )


@query(r"""WITH c AS (SELECT email_id, unnest(string_split(subject, '')) AS ch, generate_subscripts(string_split(subject, ''), 1) AS i FROM emails WHERE subject IS NOT NULL AND subject <> '')
SELECT email_id, string_agg(CASE WHEN regexp_matches(ch, '[\p{L}\p{N}]') AND regexp_matches(coalesce(before, ' '), '[\p{L}\p{N}]') THEN '*' ELSE ch END, '' ORDER BY i) AS masked FROM (SELECT *, lag(ch) OVER (PARTITION BY email_id ORDER BY i) AS before FROM c) x GROUP BY email_id""")
def text_masks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "emails").filter("subject <> ''").select("email_id", tx.mask("subject").alias("masked"))


@query("""SELECT DISTINCT state_id, try_cast(list_extract(string_split(state_id, '/'), -1) AS INT) AS place, length(state_id) // 4 AS tokens FROM draft WHERE state_id IS NOT NULL""")
def text_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """The number at the end of an id, and the rough token count of a text."""
    return table(spark, d, "draft").filter("state_id is not null").select("state_id", tx.suffix_index("state_id").alias("place"), tx.tokens_about("state_id").cast("bigint").alias("tokens")).distinct()


@query("""SELECT half, count(*) AS n FROM (SELECT CASE WHEN id LIKE '%0' THEN 'A' WHEN id LIKE '%1' THEN 'B' WHEN source = 'model_render_a' THEN 'A' WHEN source = 'model_render_b' THEN 'B' ELSE 'none' END AS half FROM records) x GROUP BY half""")
def text_halves(spark: SparkSession, d: str) -> DataFrame:
    """Halves of the evaluation set: what the id says comes before what the source says."""
    by_id = F.when(F.col("id").endswith("0"), "A").when(F.col("id").endswith("1"), "B")
    by_source = F.when(F.col("source") == "model_render_a", "A").when(F.col("source") == "model_render_b", "B")
    return table(spark, d, "records").groupBy(F.coalesce(by_id, by_source, F.lit("none")).alias("half")).agg(F.count("*").alias("n"))


def _pad(byte: int) -> str:
    key = bytes.fromhex(KEY) + bytes(64 - len(KEY) // 2)
    return bytes(b ^ byte for b in key).hex()


@query(f"""SELECT user_id, substr(sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(user_id)))), 1, 16) AS public_id FROM (SELECT DISTINCT {_UID.format('user_id')} AS user_id FROM users) u WHERE user_id IS NOT NULL""")
def release_user_ids(spark: SparkSession, d: str) -> DataFrame:
    """Public ids of users: the keyed digest of their one spelling."""
    u = table(spark, d, "users").select(canonical_user("user_id").alias("user_id")).filter("user_id is not null").distinct()
    return u.select("user_id", F.substring(tx.hmac_sha256("user_id", KEY), 1, 16).alias("public_id"))


_REQUIRED, _FORBIDDEN = ("Current time:", "user"), ("roommate", "post", "5")


def _found(a: str) -> str:
    return rf"regexp_matches(f, '(^|[^A-Za-z0-9]){a}($|[^A-Za-z0-9.,]|[.,]($|[^0-9]))')" if a[-1].isalnum() else rf"regexp_matches(f, '(^|[^A-Za-z0-9]){a}')"


@query(rf"""WITH t AS (SELECT DISTINCT id, trim(regexp_replace(translate(state, '‘’“”–—   ', '''''""--   '), '{_WS}', ' ', 'g'), ' ') AS f FROM records WHERE state IS NOT NULL)
SELECT id, CASE WHEN NOT ({' AND '.join(map(_found, _REQUIRED))}) THEN 'missing_required_anchor' WHEN {' OR '.join(map(_found, _FORBIDDEN))} THEN 'forbidden_anchor_present' END AS broken, {' + '.join(f'CASE WHEN {_found(a)} THEN 0 ELSE 1 END' for a in _REQUIRED)} AS n_missing FROM t""")
def anchor_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Whether each state keeps its contract: anchors that it must hold verbatim, and such that it must not."""
    r = table(spark, d, "records").filter("state is not null").select("id", "state").distinct()
    need, ban = (F.array(*map(F.lit, x)) for x in (_REQUIRED, _FORBIDDEN))
    return r.select("id", tx.anchor_contract("state", need, ban).alias("broken"), F.size(tx.missing_anchors("state", need)).alias("n_missing"))


_SENTENCES = r"list_transform(regexp_extract_all(t, '[^.!?\n]+[.!?]?'), lambda s: trim(s, ' '))"


@query(rf"""WITH v AS (SELECT row_id, user_id, item_id, rating, trim(coalesce(text, ''), ' ') AS t, substr(timestamp, 1, 10) AS day FROM interactions WHERE user_id IS NOT NULL AND rating IS NOT NULL),
e AS (SELECT *, list_extract(list_filter({_SENTENCES}, lambda s: length(s) BETWEEN 12 AND 200), 1) AS first_fit, substr(t, 1, 200) AS h FROM v),
f AS (SELECT *, coalesce(first_fit, CASE WHEN length(t) > 200 AND position(' ' IN h) > 0 AND length(h) - position(' ' IN reverse(h)) >= 12 THEN substr(h, 1, length(h) - position(' ' IN reverse(h))) ELSE h END) AS evidence FROM e)
SELECT f.row_id, row_number() OVER (PARTITION BY f.user_id ORDER BY f.row_id) - 1 AS place, day, CASE WHEN f.rating >= 4 THEN 'likes' WHEN f.rating <= 2 THEN 'dislikes' ELSE 'mixed' END AS polarity,
CASE WHEN f.rating >= 4 THEN 'Loved ' WHEN f.rating <= 2 THEN 'Disliked ' ELSE 'Felt mixed about ' END || i.name || ' (' || trim(regexp_replace(replace(i.category, '_', ' '), '{_WS}', ' ', 'g'), ' ') || CASE WHEN coalesce(i.city, '') <> '' THEN ', ' || i.city ELSE '' END || '): "' || CASE WHEN evidence = '' THEN 'rated it ' || f.rating || ' out of 5' ELSE evidence END || '"' AS fact
FROM f JOIN items i ON i.item_id = f.item_id""")
def memory_facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact per rated row: what was liked, with a verbatim sentence as evidence, numbered within the user."""
    v = table(spark, d, "interactions").filter("user_id is not null and rating is not null")
    i = table(spark, d, "items").select("item_id", "name", "category", "city")
    x = v.join(i, "item_id")
    rated = F.concat(F.lit("rated it "), F.col("rating").cast("string"), F.lit(" out of 5"))
    evidence = F.coalesce(F.nullif(tx.evidence_span("text"), F.lit("")), rated)
    polarity = F.when(F.col("rating") >= 4, "likes").when(F.col("rating") <= 2, "dislikes").otherwise("mixed")
    verb = F.when(F.col("rating") >= 4, "Loved ").when(F.col("rating") <= 2, "Disliked ").otherwise("Felt mixed about ")
    fact = F.concat(verb, tx.describe("name", "category", "city"), F.lit(': "'), evidence, F.lit('"'))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("row_id")) - 1
    return x.select("row_id", place.alias("place"), F.substring("timestamp", 1, 10).alias("day"), polarity.alias("polarity"), fact.alias("fact"))


@query("""SELECT row_id, CASE WHEN length(e) BETWEEN 12 AND 200 AND contains(text, e) THEN e END AS evidence FROM (SELECT row_id, text, trim(CASE WHEN row_id % 3 = 0 THEN substr(text, 3, 40) WHEN row_id % 3 = 1 THEN upper(text) ELSE substr(text, 1, 8) END, ' ') AS e FROM interactions) x""")
def verified_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Proposed evidence is taken only when it stands in the text verbatim."""
    said = F.expr("CASE WHEN row_id % 3 = 0 THEN substr(text, 3, 40) WHEN row_id % 3 = 1 THEN upper(text) ELSE substr(text, 1, 8) END")
    return table(spark, d, "interactions").select("row_id", tx.verified_evidence("text", said).alias("evidence"))


@query()
def text_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Mail bodies with web and mail addresses and phone numbers replaced, by the five ordered rules (look-around, so no SQL)."""
    return table(spark, d, "emails").select("email_id", tx.scrub("body").alias("scrubbed"))


_KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "STREET_ADDRESS", "PERSON_NAME")
_COUNTED = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{k}' AS kind, CAST(coalesce(sum(len(regexp_extract_all({c}, '\\[{k}\\]'))), 0) AS BIGINT) AS n, count(*) FILTER (contains({c}, '[{k}]')) AS n_texts FROM {t}"
    for t, c in (("interactions", "text"), ("emails", "body"), ("records", "state")) for k in _KINDS
)


@query(_COUNTED)
def placeholder_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Typed placeholders per table and kind: how often they stand and in how many texts."""
    out = None
    for t, c in (("interactions", "text"), ("emails", "body"), ("records", "state")):
        each = table(spark, d, t).agg(*[f for k in _KINDS for f in (F.coalesce(F.sum(F.regexp_count(c, F.lit(rf"\[{k}\]"))), F.lit(0)).alias(f"{k}|n"), F.count_if(F.contains(c, F.lit(f"[{k}]"))).alias(f"{k}|m"))])
        rows = F.array(*[F.struct(F.lit(t).alias("tbl"), F.lit(k).alias("kind"), F.col(f"{k}|n").alias("n"), F.col(f"{k}|m").alias("n_texts")) for k in _KINDS])
        one = each.select(F.explode(rows).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out


@query(r"SELECT doc_id, regexp_replace('<|user|>' || substr(text, 1, 20) || '<|end|>', '<\|([^|>]*)\|>', '<¦\1¦>', 'g') AS safe FROM documents WHERE text IS NOT NULL")
def text_defang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", tx.defang(F.concat(F.lit("<|user|>"), F.substring("text", 1, 20), F.lit("<|end|>"))).alias("safe"))


@query("""WITH q AS (SELECT id, q.qid AS qid, q.criteria AS c, row_number() OVER (PARTITION BY id, q.qid ORDER BY q.label_idx) AS copy FROM (SELECT id, unnest(questions) AS q FROM records) x),
a AS (SELECT id, qid, c, CASE ascii(substr(id, -1)) % 4 WHEN 0 THEN c[1].key WHEN 1 THEN c[2].key || ': because' WHEN 2 THEN c[1].key || 'x: no' ELSE ' ' || c[1].key || ' ' END AS answer FROM q WHERE copy = 1)
SELECT id, qid, CASE WHEN len(list_filter(c, lambda o: o.key = trim(answer, ' '))) > 0 THEN trim(answer, ' ') WHEN len(list_filter(c, lambda o: starts_with(trim(answer, ' '), o.key || ': '))) = 1 THEN list_filter(c, lambda o: starts_with(trim(answer, ' '), o.key || ': '))[1].key END AS chosen FROM a""")
def resolved_options(spark: SparkSession, d: str) -> DataFrame:
    """Which option a written answer names."""
    q = table(spark, d, "records").select("id", F.explode("questions").alias("q")).select("id", F.col("q.qid").alias("qid"), F.transform("q.criteria", lambda c: c["key"]).alias("keys")).dropDuplicates(["id", "qid"])
    kind = F.ascii(F.substring("id", -1, 1)) % 4
    first, second = F.get("keys", 0), F.get("keys", 1)
    answer = F.when(kind == 0, first).when(kind == 1, F.concat(second, F.lit(": because"))).when(kind == 2, F.concat(first, F.lit("x: no"))).otherwise(F.concat(F.lit(" "), first, F.lit(" ")))
    return q.select("id", "qid", tx.resolve_option(answer, "keys").alias("chosen"))


@query("""SELECT DISTINCT state_id, json_extract_string(structured, '$.now') AS now, json_extract_string(structured, '$.pending') AS pending, coalesce(json_array_length(structured, '$.profile'), 0) AS n_profile FROM draft WHERE structured IS NOT NULL""")
def reply_json(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the JSON object in a reply, with or without a code fence around it."""
    x = table(spark, d, "draft").filter("structured is not null")
    fence = F.concat(F.lit("Here it is:\n```json\n"), F.col("structured"), F.lit("\n```"))
    reply = F.when(F.length("state_id") % 2 == 0, fence).otherwise(F.concat(F.lit("Sure: "), F.col("structured")))
    j = tx.fenced_json(reply, "now string, pending string, profile array<string>")
    return x.select("state_id", j.getField("now").alias("now"), j.getField("pending").alias("pending"), F.coalesce(F.size(j.getField("profile")), F.lit(0)).cast("bigint").alias("n_profile")).distinct()


@query("""SELECT item_id, (CASE WHEN length(name) <= 30 THEN 1 ELSE 0 END) + (CASE WHEN length(description) <= 30 THEN 1 ELSE 0 END) + (CASE WHEN length(city) <= 30 THEN 1 ELSE 0 END) AS n_short FROM items""")
def short_attributes(spark: SparkSession, d: str) -> DataFrame:
    """How many of an item's values are short enough to be kept."""
    m = F.map_from_arrays(F.array(F.lit("name"), F.lit("description"), F.lit("city")), F.array("name", "description", "city"))
    return table(spark, d, "items").select("item_id", F.size(tx.short_values(m, 30)).alias("n_short"))
