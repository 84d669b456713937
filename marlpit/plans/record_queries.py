"""Queries of selecting, composing and reporting on records, with SQL written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions.ids import canonical_user, hash_hex, hash_unit
from marlpit.operators import evaluation as ev
from marlpit.operators import statistics as st
from marlpit.plans.evaluation_queries import _PAIRS, _Q, _questions, _rounded, _s, _scored
from marlpit.plans.views import ansi_sql
from marlpit.session import small
from marlpit.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_UID = "nullif(lower(regexp_replace({}, '[\\s\\-]+', '', 'g')), '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ansi_sql(sql)
        return f

    return add


def _hex(*parts: str) -> str:
    return "substr(sha256(" + " || ':' || ".join(parts) + "), 1, 16)"


# ---- selection


@query(f"""WITH u AS (SELECT DISTINCT {_UID.format('user_id')} AS u FROM users WHERE user_id IS NOT NULL), s AS (SELECT u FROM u WHERE CAST(('0x' || substr(sha256('pick:' || u), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.05)
SELECT row_id, item_id FROM interactions WHERE {_UID.format('user_id')} IN (SELECT u FROM s) AND coalesce(text, '') <> ''""")
def selected_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The texted rows of the users that a hash selects."""
    u = table(spark, d, "users").select(canonical_user("user_id").alias("u")).filter("u is not null").distinct()
    chosen = u.filter(hash_unit(F.lit("pick"), "u") < 0.05)
    v = table(spark, d, "interactions").filter("text <> ''").withColumn("u", canonical_user("user_id"))
    return v.join(chosen, "u", "left_semi").select("row_id", "item_id")


@query(f"""SELECT {_UID.format('user_id')} AS user_id, count(*) AS n_facts, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS n_forgotten FROM (SELECT user_id, rating, CAST(('0x' || substr(sha256('forget:' || row_id), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.1 AS f FROM interactions WHERE user_id IS NOT NULL AND rating IS NOT NULL) x
GROUP BY 1 HAVING sum(CASE WHEN f THEN 1 ELSE 0 END) < count(*)""")
def active_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts per user and those the user asked to forget; users with nothing left are out."""
    v = table(spark, d, "interactions").filter("user_id is not null and rating is not null").select(canonical_user("user_id").alias("user_id"), "row_id")
    asked = v.filter(hash_unit(F.lit("forget"), F.col("row_id").cast("string")) < 0.1).select("row_id")
    active = v.join(asked, "row_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("active"))
    return v.groupBy("user_id").agg(F.count("*").alias("n_facts")).join(active, "user_id").select("user_id", "n_facts", (F.col("n_facts") - F.col("active")).alias("n_forgotten"))


@query("""SELECT target, item, place, round(gap, 6) AS gap FROM (SELECT a.p_partkey AS target, b.p_partkey AS item, round(abs(ln(1 + a.p_retailprice) - ln(1 + b.p_retailprice)) + abs(ln(1.0::DOUBLE + a.p_size) - ln(1.0::DOUBLE + b.p_size)), 9) AS gap,
row_number() OVER (PARTITION BY a.p_partkey ORDER BY round(abs(ln(1 + a.p_retailprice) - ln(1 + b.p_retailprice)) + abs(ln(1.0::DOUBLE + a.p_size) - ln(1.0::DOUBLE + b.p_size)), 9), b.p_partkey) AS place FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 100 = 0) x WHERE place <= 3""")
def nearest_items(spark: SparkSession, d: str) -> DataFrame:
    """The three items of a category closest to each query item by log price and log size; queries are the ids divisible by 100."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.log1p("p_retailprice").alias("x"), F.log1p("p_size").alias("y"))
    q = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("target"), "p_brand", F.col("x").alias("qx"), F.col("y").alias("qy"))
    gap = F.round(F.abs(F.col("qx") - F.col("x")) + F.abs(F.col("qy") - F.col("y")), 9)
    near = p.join(q, "p_brand").filter("p_partkey <> target").select("target", F.col("p_partkey").alias("item"), gap.alias("gap"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("gap", "item"))
    return _rounded(near.withColumn("place", place).filter("place <= 3").select("target", "item", "place", "gap"))


@query("""SELECT shard, count(DISTINCT id) AS n_records, count(DISTINCT meta.state_id) AS n_states, count(DISTINCT meta.user_id) AS n_users, CASE WHEN count(DISTINCT id) < 100 THEN 'short_shard' END AS warning, max(length(state)) > 2400 AS has_long FROM records WHERE id IS NOT NULL GROUP BY shard""")
def shard_index(spark: SparkSession, d: str) -> DataFrame:
    """What a shard holds, and a warning where it is short."""
    r = table(spark, d, "records").filter("id is not null")
    n = F.count_distinct("id")
    return r.groupBy("shard").agg(n.alias("n_records"), F.count_distinct("meta.state_id").alias("n_states"), F.count_distinct("meta.user_id").alias("n_users"), F.when(n < 100, "short_shard").alias("warning"), (F.max(F.length("state")) > 2400).alias("has_long"))


# ---- composition


@query(f"""WITH f AS (SELECT {_UID.format('user_id')} AS u, row_id, substr(timestamp, 1, 10) AS day, rating <= 2 AS needed FROM interactions WHERE user_id IS NOT NULL AND rating IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY needed DESC, {_hex("'filler'", "row_id")}, row_id) AS k FROM f)
SELECT u AS user_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY day NULLS FIRST, row_id) AS facts FROM r WHERE k <= 8 GROUP BY u""")
def memory_sections(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight facts per user: those that are needed first, then fillers by hash, shown by date."""
    v = table(spark, d, "interactions").filter("user_id is not null and rating is not null")
    v = v.select(canonical_user("user_id").alias("user_id"), "row_id", F.substring("timestamp", 1, 10).alias("day"), (F.col("rating") <= 2).alias("needed"))
    order = Window.partitionBy("user_id").orderBy(F.desc("needed"), hash_hex(F.lit("filler"), F.col("row_id").cast("string")), "row_id")
    kept = v.withColumn("k", F.row_number().over(order)).filter("k <= 8")
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("day", F.lit("")).alias("day"), "row_id")))  # eight at most
    return kept.groupBy("user_id").agg(rows.alias("x")).select("user_id", F.concat_ws(",", F.transform("x", lambda s: s["row_id"].cast("string"))).alias("facts"))


@query(f"""WITH {_Q}, w AS (SELECT record_id, qid, k, label, CAST(CAST(('0x' || {_hex("'place'", 'record_id', 'qid')}) AS UBIGINT) % k AS INT) AS place FROM q WHERE kind = 'choice' AND label IS NOT NULL),
l AS (SELECT record_id, qid, list(key ORDER BY i) AS others FROM o JOIN w USING (record_id, qid) WHERE o.i <> w.label GROUP BY ALL), a AS (SELECT record_id, qid, key AS answer FROM o WHERE i = label)
SELECT record_id, qid, place, array_to_string(list_concat(list_concat(others[1:place], [answer]), others[place + 1:]), '|') AS options FROM w JOIN l USING (record_id, qid) JOIN a USING (record_id, qid)""")
def placed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Choices with the right option moved to a hashed place, the others in their order."""
    q = _questions(spark, d).filter("kind = 'choice' and label is not null")
    n = F.size("keys")
    place = F.pmod(F.conv(hash_hex(F.lit("place"), "record_id", "qid"), 16, 10).cast("decimal(20,0)"), n).cast("int")
    others = F.filter("keys", lambda k, i: i != F.col("label"))
    q = q.withColumn("place", place).withColumn("others", others)
    moved = F.concat(F.slice("others", F.lit(1), F.col("place")), F.array(F.get("keys", F.col("label"))), F.slice("others", F.col("place") + 1, n))
    return q.select("record_id", "qid", "place", F.concat_ws("|", moved).alias("options"))


@query(f"""WITH m AS (SELECT email_id, length(body) AS size, {_hex("'distractor'", 'email_id')} AS h FROM emails WHERE body IS NOT NULL AND body <> '' AND NOT contains(lower(body), 'survey')),
g AS (SELECT *, CAST(CAST(('0x' || {_hex("'group'", 'email_id')}) AS UBIGINT) % 40 AS INT) AS state FROM m), s AS (SELECT *, sum(size) OVER (PARTITION BY state ORDER BY h, email_id) - size AS before FROM g)
SELECT state, email_id, CAST(before AS BIGINT) AS before FROM s WHERE before < 2000""")
def distractors(spark: SparkSession, d: str) -> DataFrame:
    """Mails for each of forty states, in hash order until their sizes reach a budget, none with a guarded word."""
    m = table(spark, d, "emails").filter("body <> '' and not contains(lower(body), 'survey')").select("email_id", F.length("body").alias("size"), hash_hex(F.lit("distractor"), "email_id").alias("h"))
    state = F.pmod(F.conv(hash_hex(F.lit("group"), "email_id"), 16, 10).cast("decimal(20,0)"), F.lit(40)).cast("int")
    order = Window.partitionBy("state").orderBy("h", "email_id").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("state", state).withColumn("before", F.sum("size").over(order) - F.col("size")).filter("before < 2000").select("state", "email_id", "before")


@query("""WITH p AS (SELECT DISTINCT state_id, json_extract_string(structured, '$.now') AS a, json_extract_string(structured, '$.pending') AS b, documents[1] AS doc FROM draft WHERE len(documents) > 0 AND structured IS NOT NULL)
SELECT state_id, CASE length(state_id) % 3 WHEN 0 THEN concat_ws(chr(10) || chr(10), doc, a, b) WHEN 1 THEN concat_ws(chr(10) || chr(10), a, doc, b) ELSE concat_ws(chr(10) || chr(10), a, b, doc) END AS mixed FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def interleaved_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first document of a draft set between its paragraphs at a given slot."""
    x = table(spark, d, "draft").filter("size(documents) > 0 and structured is not null").select("state_id", F.from_json("structured", "now string, pending string").alias("j"), F.get("documents", 0).alias("doc")).distinct()
    parts = F.array("j.now", "j.pending")
    slot = F.length("state_id") % 3
    mixed = F.concat(F.slice(parts, F.lit(1), slot), F.array("doc"), F.slice(parts, slot + 1, F.lit(2)))
    return x.filter("j.now is not null and j.pending is not null").select("state_id", F.concat_ws("\n\n", mixed).alias("mixed"))


_OPT = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS o, min(l_extendedprice) AS price, min(l_quantity) AS pop FROM {lineitem} GROUP BY ALL), n AS (SELECT k, count(*) AS m FROM l GROUP BY k HAVING count(*) BETWEEN 3 AND 5),
c AS (SELECT l.*, ln(1.0::DOUBLE + price) AS x, ln(1.0::DOUBLE + pop) AS y, n.m, substr(sha256('truth:' || k || ':' || o), 1, 16) AS h FROM l JOIN n USING (k)),
z AS (SELECT *, avg(x) OVER (PARTITION BY k) AS cx, avg(y) OVER (PARTITION BY k) AS cy FROM c), g AS (SELECT a.k, a.o, sum(abs(a.x - b.x) + abs(a.y - b.y)) AS gap FROM c a JOIN c b USING (k) GROUP BY ALL),
t AS (SELECT z.k, min(m) AS m, arg_min(z.o, h) AS truth, min(z.o) AS first_, arg_min(z.o, (price, z.o)) AS cheapest, arg_max(z.o, (price, -z.o)) AS priciest, arg_min(z.o, (pop, z.o)) AS least_popular, arg_max(z.o, (pop, -z.o)) AS most_popular,
 arg_min(z.o, (round(gap, 9), z.o)) AS medoid, arg_min(z.o, (round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 9), z.o)) AS centroid FROM z JOIN g ON g.k = z.k AND g.o = z.o GROUP BY z.k)"""


@query(_OPT + " " + " UNION ALL ".join(f"SELECT '{p}' AS predictor, count(*) AS n, round(avg(CASE WHEN {c} = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(1.0 / m), 6) AS chance FROM t" for p, c in [("first", "first_")] + [(x, x) for x in ("cheapest", "priciest", "least_popular", "most_popular", "medoid", "centroid")]))
def shortcut_predictors(spark: SparkSession, d: str) -> DataFrame:
    """How often a rule that knows only the options' features hits a hashed truth, beside chance; choice sets are orders of three to five lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("o")).agg(F.min("l_extendedprice").alias("price"), F.min("l_quantity").alias("pop"))
    feature = F.struct("o", "price", "pop", F.log1p("price").alias("x"), F.log1p("pop").alias("y"), hash_hex(F.lit("truth"), F.col("k").cast("string"), F.col("o").cast("string")).alias("h"))
    sets = lines.groupBy("k").agg(F.array_sort(F.collect_list(feature)).alias("s")).filter("size(s) between 3 and 5")  # a choice has few options
    mean = lambda f: F.aggregate("s", F.lit(0.0), lambda a, e: a + e[f]) / F.size("s")
    sets = sets.withColumn("cx", mean("x")).withColumn("cy", mean("y"))
    pick = lambda key: F.array_min(F.transform("s", lambda e: F.struct(key(e).alias("v"), e["o"].alias("o"))))["o"]
    gap = lambda e: F.round(F.aggregate("s", F.lit(0.0), lambda a, u: a + F.abs(e["x"] - u["x"]) + F.abs(e["y"] - u["y"])), 9)
    off = lambda e: F.round(F.sqrt(F.pow(e["x"] - F.col("cx"), 2) + F.pow(e["y"] - F.col("cy"), 2)), 9)
    rules = {"first": lambda e: e["o"], "cheapest": lambda e: e["price"], "priciest": lambda e: -e["price"], "least_popular": lambda e: e["pop"], "most_popular": lambda e: -e["pop"], "medoid": gap, "centroid": off}
    wide = sets.select(F.size("s").alias("m"), pick(lambda e: e["h"]).alias("truth"), *[pick(r).alias(n) for n, r in rules.items()])
    each = wide.select("m", "truth", F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), F.col(n).alias("guess")) for n in rules])).alias("p")).select("m", "truth", "p.*")
    return _rounded(each.groupBy("predictor").agg(F.count("*").alias("n"), F.avg((F.col("guess") == F.col("truth")).cast("double")).alias("accuracy"), F.avg(1.0 / F.col("m")).alias("chance")))


# ---- reports


@query(f"""{_PAIRS} SELECT family, count(*) AS n, round(avg(CASE WHEN x THEN 1.0 ELSE 0.0 END), 6) AS base, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 6) AS cand, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN x THEN 1.0 ELSE 0.0 END), 6) AS delta, count(*) FILTER (y AND NOT x) AS gained, count(*) FILTER (x AND NOT y) AS lost FROM pr GROUP BY family""")
def paired_report(spark: SparkSession, d: str) -> DataFrame:
    """Both predictors per family, their difference and the discordant questions."""
    a = _scored(spark, d, "base").select("record_id", "qid", "family", F.col("correct").alias("x"))
    both = a.join(_scored(spark, d, "cand").select("record_id", "qid", F.col("correct").alias("y")), ["record_id", "qid"]).filter("x is not null")
    base, cand = F.avg(F.col("x").cast("double")), F.avg(F.col("y").cast("double"))
    return _rounded(both.groupBy("family").agg(F.count("*").alias("n"), base.alias("base"), cand.alias("cand"), (cand - base).alias("delta"), F.count_if(F.col("y") & ~F.col("x")).alias("gained"), F.count_if(F.col("x") & ~F.col("y")).alias("lost")))


@query(f"""{_PAIRS} SELECT round(avg(b), 6) AS base, round(avg(c), 6) AS cand, round(avg(c) - avg(b), 6) AS delta, avg(c) - avg(b) >= -1e-12 AS passed FROM (SELECT family, avg(CASE WHEN x THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS c FROM pr GROUP BY family) z""")
def guard_report(spark: SparkSession, d: str) -> DataFrame:
    """Macro accuracy of both predictors on a guard set, which must not fall."""
    a = _scored(spark, d, "base").groupBy("family").agg(F.avg(F.col("correct").cast("double")).alias("b")).join(_scored(spark, d, "cand").groupBy("family").agg(F.avg(F.col("correct").cast("double")).alias("c")), "family")
    m = a.agg(F.avg("b").alias("base"), F.avg("c").alias("cand")).withColumn("delta", F.col("cand") - F.col("base"))
    return _rounded(m.withColumn("passed", F.col("delta") >= -1e-12))


@query()
def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    """How far two predictors that differ in nothing but their seed lie apart: intervals per family and in the mean."""
    q = _questions(spark, d)
    one, two = (ev.scored(q, ev.stand_in_predictions(q, n, 1.6)) for n in ("seed_a", "seed_b"))
    boot = st.paired_bootstrap(st.clusters_of(one, two), 2_000)
    return _rounded(boot.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0)))


@query(f"""{_PAIRS}, a AS (SELECT 'primary' AS part, family, x, y FROM pr UNION ALL SELECT 'sensitivity', family, x, y FROM pr WHERE family <> 'pick_option'),
m AS (SELECT part, avg(c) - avg(b) AS delta FROM (SELECT part, family, avg(CASE WHEN x THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS c FROM a GROUP BY ALL) z GROUP BY part)
SELECT round(p.delta, 6) AS main_delta, round(s.delta, 6) AS sensitivity_delta, sign(p.delta) = sign(s.delta) AS same_sign FROM (SELECT delta FROM m WHERE part = 'primary') p, (SELECT delta FROM m WHERE part = 'sensitivity') s""")
def sensitivity_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether leaving out one family changes the direction of the result."""
    a = _scored(spark, d, "base").select("record_id", "qid", "family", F.col("correct").cast("double").alias("x"))
    both = a.join(_scored(spark, d, "cand").select("record_id", "qid", F.col("correct").cast("double").alias("y")), ["record_id", "qid"])
    per = both.groupBy("family").agg((F.avg("y") - F.avg("x")).alias("delta"))
    out = per.agg(F.avg("delta").alias("main_delta"), F.avg(F.when(F.col("family") != "pick_option", F.col("delta"))).alias("sensitivity_delta"))
    return _rounded(out.withColumn("same_sign", F.signum("main_delta") == F.signum("sensitivity_delta")))


@query("""SELECT count(*) FILTER (source IS NULL) AS unknown_source, count(*) FILTER (source NOT IN ('model_render_a', 'model_render_b', 'fixture_template', 'human_rewrite')) AS other_source,
count(*) FILTER ((source = 'model_render_a' AND id LIKE '%1') OR (source = 'model_render_b' AND id LIKE '%0')) AS conflicting_half, count(*) - count(DISTINCT id) AS repeated FROM records WHERE id IS NOT NULL""")
def placement_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records whose half cannot be told, or is told differently by id and source."""
    r, s = table(spark, d, "records").filter("id is not null"), F.col("source")
    clash = ((s == "model_render_a") & F.col("id").endswith("1")) | ((s == "model_render_b") & F.col("id").endswith("0"))
    return r.agg(F.count_if(s.isNull()).alias("unknown_source"), F.count_if(~s.isin("model_render_a", "model_render_b", "fixture_template", "human_rewrite")).alias("other_source"), F.count_if(clash).alias("conflicting_half"), (F.count("*") - F.count_distinct("id")).alias("repeated"))


@query(f"""WITH {_Q}, ph AS (SELECT DISTINCT record_id, unnest([key, c.desc]) AS phrase FROM named) SELECT record_id, count(*) AS n_phrases, CAST(sum(length(phrase)) AS BIGINT) AS chars FROM ph WHERE phrase IS NOT NULL AND length(phrase) >= 3 GROUP BY record_id""")
def protected_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The option names and descriptions of a record, inside which nothing is replaced."""
    r = table(spark, d, "records").filter("id is not null").select(F.col("id").alias("record_id"), F.explode("questions").alias("q"))
    words = r.select("record_id", F.explode(F.flatten(F.transform("q.criteria", lambda c: F.array(c["key"], c["desc"])))).alias("phrase")).filter("length(phrase) >= 3").distinct()
    return words.groupBy("record_id").agg(F.count("*").alias("n_phrases"), F.sum(F.length("phrase")).alias("chars"))


@query(f"""WITH {_Q} SELECT count(DISTINCT record_id) AS n_records, count(*) FILTER (len(long) > 0) AS exposed FROM (SELECT record_id, list_filter(list(c.desc), lambda x: length(x) >= 20) AS long FROM opts GROUP BY record_id) x""")
def long_anchor_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Records with an option text long enough to be found again elsewhere."""
    r = table(spark, d, "records").filter("id is not null").select(F.col("id").alias("record_id"), F.explode("questions").alias("q"))
    per = r.groupBy("record_id").agg(F.max(F.exists("q.criteria", lambda c: F.coalesce(F.length(c["desc"]) >= 20, F.lit(False)))).alias("long"))
    return per.agg(F.count("*").alias("n_records"), F.count_if("long").alias("exposed"))


@query("""SELECT count(DISTINCT r.id) AS n_records, count(DISTINCT r.id) FILTER (d.state_id IS NULL) AS foreign_rows, count(DISTINCT r.id) FILTER (contains(r.state, '@')) AS with_sign, count(DISTINCT r.id) FILTER (contains(r.state, '[PHONE]') OR contains(r.state, '[EMAIL]')) AS with_placeholder
FROM records r LEFT JOIN (SELECT DISTINCT state_id FROM draft) d ON d.state_id = r.meta.state_id WHERE r.id IS NOT NULL""")
def export_receipt(spark: SparkSession, d: str) -> DataFrame:
    """What a release would hold: records, rows without a draft, texts with a sign that addresses have, texts with placeholders."""
    r = table(spark, d, "records").filter("id is not null").select("id", "state", F.col("meta.state_id").alias("state_id"))
    known = table(spark, d, "draft").select("state_id", F.lit(True).alias("known")).distinct()
    x = r.join(known, "state_id", "left")
    only = lambda c: F.count_distinct(F.when(c, F.col("id")))
    holds = lambda s: F.contains("state", F.lit(s))
    return x.agg(F.count_distinct("id").alias("n_records"), only(F.col("known").isNull()).alias("foreign_rows"), only(holds("@")).alias("with_sign"), only(holds("[PHONE]") | holds("[EMAIL]")).alias("with_placeholder"))


@query(f"""WITH {_Q} SELECT record_id, qid, family || '/' || CASE kind WHEN 'noul' THEN 'noul' WHEN 'score' THEN 'score' ELSE 'place' END || '/' || k AS slot FROM q""")
def schedule_keys(spark: SparkSession, d: str) -> DataFrame:
    """The slot of the label schedule that a question fills: family, form and number of options."""
    form = F.when(F.col("kind") == "noul", "noul").when(F.col("kind") == "score", "score").otherwise("place")
    return _questions(spark, d).select("record_id", "qid", F.concat_ws("/", "family", form, F.size("keys").cast("string")).alias("slot"))


@query(f"""WITH {_Q}, {_s('cand')}, u AS (SELECT s.family, r.meta_user AS user_id, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS share FROM s_cand s JOIN (SELECT id, min({_UID.format('meta.user_id')}) AS meta_user FROM records GROUP BY id) r ON r.id = s.record_id WHERE NOT ambiguous GROUP BY ALL)
SELECT family, count(*) AS n_users, round(avg(share), 6) AS mean_share, count(*) FILTER (share > 0) AS feasible FROM u GROUP BY family""")
def capacity(spark: SparkSession, d: str) -> DataFrame:
    """Shares of successful trials per user and family, rolled up to the family."""
    owner = table(spark, d, "records").groupBy(F.col("id").alias("record_id")).agg(F.min(canonical_user(F.col("meta.user_id"))).alias("user_id"))
    per = _scored(spark, d, "cand").filter("not ambiguous").join(owner, "record_id").groupBy("family", "user_id").agg(F.avg(F.col("correct").cast("double")).alias("share"))
    return _rounded(per.groupBy("family").agg(F.count("*").alias("n_users"), F.avg("share").alias("mean_share"), F.count_if(F.col("share") > 0).alias("feasible")))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT state_id FROM draft WHERE state_id IS NOT NULL) d WHERE state_id NOT IN (SELECT meta.state_id FROM records WHERE meta.state_id IS NOT NULL)) AS pending, (SELECT count(DISTINCT meta.state_id) FROM records) AS final""")
def pending_states(spark: SparkSession, d: str) -> DataFrame:
    """Drafts without a record yet; a shard may be finalized only when there is none."""
    drafts, done = table(spark, d, "draft").select("state_id").dropna().distinct(), table(spark, d, "records").select(F.col("meta.state_id").alias("state_id")).dropna().distinct()
    left = drafts.join(done, "state_id", "left_anti").agg(F.count("*").alias("pending"))
    return left.crossJoin(done.agg(F.count("*").alias("final")))  # one row by one row


@query(f"""WITH {_Q} SELECT record_id, qid, CASE WHEN bool_or(soft IS NOT NULL) THEN string_agg(key || '=' || format('{{:.3f}}', t), ';' ORDER BY i) ELSE max(CASE WHEN i = label THEN key END) END AS target FROM o GROUP BY record_id, qid""")
def second_layout(spark: SparkSession, d: str) -> DataFrame:
    """Questions in the other record layout: one target field, soft where the label is soft."""
    r = table(spark, d, "records").filter("id is not null").select(F.col("id").alias("record_id"), F.explode("questions").alias("q")).select("record_id", F.col("q.qid").alias("qid"), F.col("q.soft_label").isNotNull().alias("soft"))
    q = _questions(spark, d).join(small(r.distinct()), ["record_id", "qid"])
    soft = F.concat_ws(";", F.zip_with("keys", "target", lambda k, t: F.concat(k, F.lit("="), F.format_string("%.3f", t))))
    return q.select("record_id", "qid", F.when(F.col("soft"), soft).otherwise(F.get("keys", F.col("label"))).alias("target"))
