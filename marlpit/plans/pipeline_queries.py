"""Queries of building and splitting a benchmark whose plans need more than one SQL text; their SQL is written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions.ids import canonical_user, hash_hex
from marlpit.functions.text import evidence_span
from marlpit.operators import ranking as rk
from marlpit.operators.release import find_spans, released, spans_tally
from marlpit.operators.statistics import match_counts, match_kinds
from marlpit.plans.evaluation_queries import _questions
from marlpit.plans.text_queries import KEY
from marlpit.plans.views import ansi_sql, view
from marlpit.session import small
from marlpit.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SHARDS = ("test", "hidden", "dev", "val", "train")
_UID = "nullif(lower(regexp_replace({}, '[\\s\\-]+', '', 'g')), '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ansi_sql(sql)
        return f

    return add


@query("""SELECT a.item_id, count(*) AS n_similar, min(b.item_id) AS first_similar FROM ({goods}) a
JOIN ({goods}) b ON a.domain = b.domain AND a.category = b.category AND a.subcategory = b.subcategory AND a.item_id <> b.item_id GROUP BY a.item_id""")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """How many other items share an item's domain and categories, and the first of them: from counts and the two least ids of a bucket."""
    g, by = view(spark, d, "goods").select("item_id", "domain", "category", "subcategory"), ["domain", "category", "subcategory"]
    least = g.groupBy(*by).agg(F.count("*").alias("n"), F.min("item_id").alias("m1")).filter("n > 1")
    next_ = g.join(least.select(*by, "m1"), by).filter("item_id > m1").groupBy(*by).agg(F.min("item_id").alias("m2"))
    both = g.join(least.join(next_, by), by)
    return both.select("item_id", (F.col("n") - 1).alias("n_similar"), F.when(F.col("item_id") == F.col("m1"), F.col("m2")).otherwise(F.col("m1")).alias("first_similar"))


@query("""SELECT q.o_orderkey, arg_max(u.o_totalprice, u.o_orderdate) AS in_force FROM {orders} q
JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM {orders} GROUP BY o_custkey, o_orderdate) u ON u.o_custkey = q.o_custkey AND u.o_orderdate < q.o_orderdate GROUP BY q.o_orderkey""")
def asof_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The value in force at each order: that of the customer's last day before, one row per day deep instead of a range join."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    days = o.groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("top"))
    days = days.withColumn("in_force", F.lag("top").over(Window.partitionBy("o_custkey").orderBy("o_orderdate"))).filter("in_force is not null")
    return o.join(days, ["o_custkey", "o_orderdate"]).select("o_orderkey", "in_force")


@query("""SELECT c.c_nationkey AS nation, count(*) AS n_untouched FROM {customer} c JOIN {part} p ON p.p_size = c.c_nationkey + 1
WHERE NOT EXISTS (SELECT 1 FROM ({latest}) v WHERE v.user_id = c.c_custkey AND v.item_id = p.p_partkey) GROUP BY c.c_nationkey""")
def anti_untouched(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of customer and part of the nation's size without an act: all pairs by multiplication, less those with one."""
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    sizes = p.groupBy((F.col("p_size") - 1).alias("nation")).agg(F.count("*").alias("parts"))
    users = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("users"))
    acts = view(spark, d, "latest").select(F.col("user_id").alias("c_custkey"), F.col("item_id").alias("p_partkey"))
    touched = acts.join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(p.select("p_partkey", "p_size"), "p_partkey").filter("p_size = c_nationkey + 1")
    less = touched.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("less"))
    all_ = users.join(sizes, "nation").join(less, "nation", "left")
    return all_.select("nation", (F.col("users") * F.col("parts") - F.coalesce("less", F.lit(0))).alias("n_untouched")).filter("n_untouched > 0")


@query(f"""WITH m AS (SELECT DISTINCT {_UID.format('user_id')} AS u, shard FROM draft WHERE user_id IS NOT NULL AND shard IS NOT NULL),
c AS (SELECT {_UID.format('user_id')} AS u, min(cut_timestamp) AS cut FROM users WHERE user_id IS NOT NULL GROUP BY 1),
v AS (SELECT {_UID.format('user_id')} AS u, item_id, timestamp AS ts, rating, CASE WHEN length(trim(text, ' ')) >= 40 THEN sha256(trim(text, ' ')) END AS h FROM interactions),
a AS (SELECT m.shard, v.*, coalesce(v.ts > c.cut, false) AS later FROM v JOIN m USING (u) LEFT JOIN c USING (u)),
o AS (SELECT * FROM (VALUES ('test', 1), ('hidden', 2), ('dev', 3), ('val', 4), ('train', 5)) t(shard, ord)), p AS (SELECT x.shard AS first, y.shard AS second FROM o x JOIN o y ON x.ord < y.ord),
r AS (SELECT 'users' AS "check", first, second, (SELECT count(*) FROM m a1 JOIN m b1 USING (u) WHERE a1.shard = first AND b1.shard = second) AS n FROM p
UNION ALL SELECT 'user_items', first, second, count(*) FROM p JOIN a x ON x.shard = first WHERE x.later AND EXISTS (SELECT 1 FROM a y WHERE y.shard = second AND y.u = x.u AND y.item_id = x.item_id) GROUP BY ALL
UNION ALL SELECT 'texts', first, second, count(*) FROM p JOIN a x ON x.shard = first WHERE x.later AND EXISTS (SELECT 1 FROM a y WHERE y.shard = second AND y.h = x.h) GROUP BY ALL
UNION ALL SELECT 'events', first, second, count(*) FROM p JOIN a x ON x.shard = first WHERE x.later AND EXISTS (SELECT 1 FROM a y WHERE y.shard = second AND y.item_id = x.item_id AND y.ts IS NOT DISTINCT FROM x.ts AND y.rating IS NOT DISTINCT FROM x.rating) GROUP BY ALL)
SELECT "check", first, second, CAST(n AS BIGINT) AS n FROM r WHERE n > 0""")
def leakage_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The four leakage checks for every ordered pair of shards."""
    members = table(spark, d, "draft").select(canonical_user("user_id").alias("user"), "shard").dropna().distinct()
    cuts = table(spark, d, "users").select(canonical_user("user_id").alias("user"), "cut_timestamp").filter("user is not null").groupBy("user").agg(F.min("cut_timestamp").alias("cut"))
    v = table(spark, d, "interactions").select(canonical_user("user_id").alias("user"), F.col("item_id").alias("item"), F.col("timestamp").alias("ts"), "rating", F.when(F.length(F.trim("text")) >= 40, F.sha2(F.trim("text"), 256)).alias("digest"))
    acts = v.filter("user is not null").join(cuts, "user", "left").withColumn("later", F.coalesce(F.col("ts") > F.col("cut"), F.lit(False))).drop("cut")
    return rk.shard_leaks(acts, members, SHARDS)


_ORDERED = "SELECT c_custkey AS user_id, row_number() OVER (ORDER BY substr(sha256('{0}:' || CAST(c_custkey AS VARCHAR)), 1, 16), c_custkey) AS r FROM customer"


@query(f"SELECT user_id, CASE WHEN r <= 40 THEN 'hidden' WHEN r <= 100 THEN 'dev' WHEN r <= 160 THEN 'val' ELSE 'train' END AS shard FROM ({_ORDERED.format('split-v1')}) x")
def assign_shards(spark: SparkSession, d: str) -> DataFrame:
    """Fixed numbers of users in hash order to the evaluation shards, all others to train: only those first 160 are ever ordered."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    first = rk.first_by(c.withColumn("h", hash_hex(F.lit("split-v1"), F.col("user_id").cast("string"))), 160, "h", "user_id")
    shard = F.when(F.col("place") <= 40, "hidden").when(F.col("place") <= 100, "dev").otherwise("val")
    return c.join(F.broadcast(first.select("user_id", shard.alias("shard"))), "user_id", "left").select("user_id", F.coalesce("shard", F.lit("train")).alias("shard"))


@query(f"""WITH u AS (SELECT user_id, r - 1 AS place, count(*) OVER () AS n FROM ({_ORDERED.format('plan')}) x)
SELECT o.o_orderkey AS i, u.user_id, CAST(o.o_orderkey // u.n AS BIGINT) AS visit, CAST(o.o_orderkey % 7 AS INT) AS family FROM orders o JOIN u ON o.o_orderkey % u.n = u.place""")
def state_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which user each planned state is about: users in hash order, taken round and round."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).withColumn("h", hash_hex(F.lit("plan"), F.col("user_id").cast("string")))
    n = c.count()
    users = rk.global_rank(c, "h", "user_id").select("user_id", (F.col("rank") - 1).alias("place"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % max(n, 1)).alias("place"))
    return o.join(users, "place").select("i", "user_id", F.floor(F.col("i") / max(n, 1)).cast("bigint").alias("visit"), (F.col("i") % 7).cast("int").alias("family"))


@query("""SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', email_id, coalesce(date, chr(1)), coalesce(subject, chr(1)), coalesce(body, chr(1)))), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM emails""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """An identity of a table that every value of every row enters, whatever the order of the rows."""
    e = table(spark, d, "emails")
    row = F.sha2(F.concat_ws("|", "email_id", *[F.coalesce(c, F.char(F.lit(1))) for c in ("date", "subject", "body")]), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return e.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest"))


@query("""SELECT user_id, item_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY received_at DESC NULLS LAST, row_id) AS r FROM interactions WHERE user_id IS NOT NULL) x WHERE r = 1""")
def latest_first_seen(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "interactions").filter("user_id is not null").select("user_id", "item_id", "row_id", "received_at")
    return rk.latest_first_seen(v, ["user_id", "item_id"], "received_at", "row_id").select("user_id", "item_id", "row_id")


_FILLED = """WITH RECURSIVE q AS (SELECT DISTINCT id, qq.qid AS qid, coalesce(fam[qq.qid], regexp_replace(qq.src, '^[a-z]+/', '')) AS family FROM (SELECT id, meta.families AS fam, unnest(questions) AS qq FROM records WHERE id IS NOT NULL) x),
a AS (SELECT family, n, row_number() OVER (ORDER BY n, family) AS i, count(*) OVER () AS k FROM (SELECT family, count(*) AS n FROM q GROUP BY family) y),
f(i, family, available, quota, left_) AS (SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(500 AS BIGINT) UNION ALL SELECT a.i, a.family, a.n, least(a.n, f.left_ // (a.k - a.i + 1)), f.left_ - least(a.n, f.left_ // (a.k - a.i + 1)) FROM f JOIN a ON a.i = f.i + 1)"""


@query(_FILLED + " SELECT family, available, quota FROM f WHERE i > 0")
def family_quotas(spark: SparkSession, d: str) -> DataFrame:
    """500 questions split evenly over the families, small families giving all theirs."""
    return rk.water_filled(_questions(spark, d).groupBy("family").agg(F.count("*").alias("available")), "family", 500)


@query(_FILLED + """ SELECT id AS record_id, qid, family FROM (SELECT q.*, row_number() OVER (PARTITION BY q.family ORDER BY substr(sha256('mix:' || id || ':' || qid), 1, 16), id, qid) AS r FROM q) x JOIN f USING (family) WHERE r <= quota""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """The questions of each family with the smallest hashes, as many as its quota."""
    q = _questions(spark, d).select("record_id", "qid", "family").withColumn("h", hash_hex(F.lit("mix"), "record_id", "qid"))
    quotas = rk.water_filled(q.groupBy("family").agg(F.count("*").alias("available")), "family", 500)
    ranked = q.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy("h", "record_id", "qid"))).filter("r <= 500")
    return ranked.join(F.broadcast(quotas), "family").filter("r <= quota").select("record_id", "qid", "family")


@query("""SELECT state_id, seed FROM (SELECT state_id, min(seed) AS seed FROM draft WHERE state_id IS NOT NULL GROUP BY state_id) x ORDER BY seed, state_id LIMIT 300""")
def finalized_states(spark: SparkSession, d: str) -> DataFrame:
    """The first states by their index, each id once."""
    s = table(spark, d, "draft").filter("state_id is not null").groupBy("state_id").agg(F.min("seed").alias("seed"))
    return rk.first_by(s.na.drop(), 300, "seed", "state_id").select("state_id", "seed")


@query()
def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    """States in batches of like length within a token budget."""
    r = table(spark, d, "records").filter("id is not null and state is not null").groupBy("id").agg(F.max(F.ceil(F.length("state") / 4)).alias("tokens"))
    return rk.budget_batches(r, "id", "tokens", 8192).groupBy("batch").agg(F.count("*").alias("n"), F.max("tokens").alias("most"))


@query("""SELECT source, arg_max(row_id, (received_at, row_id)) AS row_id, max(received_at)::VARCHAR[:19] AS received, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM interactions WHERE received_at IS NOT NULL GROUP BY source""".replace("max(received_at)::VARCHAR[:19]", "strftime(max(received_at), '%Y-%m-%d %H:%M:%S')"))
def latest_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each source and the size of all its rows."""
    v = table(spark, d, "interactions").filter("received_at is not null")
    return v.groupBy("source").agg(
        F.max_by("row_id", F.struct("received_at", "row_id")).alias("row_id"), F.date_format(F.max("received_at"), "yyyy-MM-dd HH:mm:ss").alias("received"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))


@query("""SELECT event_type, n, round(upper_median, 6) AS upper_median, round(most, 6) AS most, round(cost, 6) AS cost FROM (SELECT event_type, count(*) AS n, max(value) AS most, sum(value) / 1e6 * 0.5 + count(*) / 1e6 * 1.5 AS cost FROM {events} GROUP BY event_type) a
JOIN (SELECT event_type, max(value) AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(value) OVER (PARTITION BY event_type) AS k FROM {events} WHERE value IS NOT NULL) x WHERE r = k // 2 + 1 GROUP BY event_type) b USING (event_type)""")
def latency_and_cost(spark: SparkSession, d: str) -> DataFrame:
    """Upper median and maximum of a measure, and what its tokens cost at two prices a million."""
    e = table(spark, d, "events")
    upper = -F.expr("percentile_disc(0.5) within group (order by -value)")
    out = e.groupBy("event_type").agg(F.count("*").alias("n"), upper.alias("upper_median"), F.max("value").alias("most"), (F.sum("value") / 1e6 * 0.5 + F.count("*") / 1e6 * 1.5).alias("cost"))
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("upper_median", "most", "cost")])


@query("""SELECT event_id, h, was, now, was <> now AS flips FROM (SELECT event_id, h, h >= 18 + user_id % 6 OR h < 5 + user_id % 4 AS was, CASE WHEN user_id % 5 = 0 THEN h >= 12 AND h < 14 ELSE h >= 20 + user_id % 4 OR h < 7 END AS now FROM (SELECT event_id, user_id, extract(hour FROM ts) AS h FROM {events}) x) y""")
def quiet_flips(spark: SparkSession, d: str) -> DataFrame:
    """Events whose hour falls in the old quiet window but not in the new one, or the other way round."""
    e = table(spark, d, "events").select("event_id", "user_id", F.hour("ts").cast("bigint").alias("h"))
    inside = lambda a, b: F.when(a < b, (F.col("h") >= a) & (F.col("h") < b)).otherwise((F.col("h") >= a) | (F.col("h") < b))
    noon = F.col("user_id") % 5 == 0
    was = inside(18 + F.col("user_id") % 6, 5 + F.col("user_id") % 4)
    now = inside(F.when(noon, 12).otherwise(20 + F.col("user_id") % 4), F.when(noon, 14).otherwise(7))
    return e.select("event_id", "h", was.alias("was"), now.alias("now")).withColumn("flips", F.col("was") != F.col("now"))


@query("""WITH r AS (SELECT DISTINCT s.s_nationkey AS src, c.c_nationkey AS dst FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey),
b AS (SELECT n_nationkey % 20 AS label FROM {nation} GROUP BY 1 HAVING count(DISTINCT n_nationkey) > 1)
SELECT src, count(*) AS n_served FROM r JOIN {nation} n ON n.n_nationkey = dst WHERE n_nationkey % 20 NOT IN (SELECT label FROM b) GROUP BY src""")
def served_places(spark: SparkSession, d: str) -> DataFrame:
    """Destinations that can be reached from each place and whose name means one place only."""
    line, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation")
    routes = line.join(small(s), F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("s_nationkey", "c_nationkey").distinct()
    named = n.select("n_nationkey", (F.col("n_nationkey") % 20).alias("label"))
    unclear = named.groupBy("label").agg(F.count_distinct("n_nationkey").alias("k")).filter("k > 1")
    clear = named.join(unclear, "label", "left_anti")
    return routes.join(small(clear), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("s_nationkey").alias("src")).agg(F.count("*").alias("n_served"))


@query(f"""WITH v AS (SELECT {_UID.format('user_id')} AS u, item_id, rating, received_at AS ts, row_id, coalesce(trim(text, ' '), '') <> '' AS has_text FROM interactions WHERE rating IS NOT NULL AND received_at IS NOT NULL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, item_id ORDER BY ts DESC, row_id DESC) AS r FROM v WHERE u IS NOT NULL) x WHERE r = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY u) AS n FROM l),
s AS (SELECT *, pos <= least(n - 1, greatest(3, round_even(n * 0.6, 0))) AS early FROM p WHERE n >= 5)
SELECT u AS user_id, count(*) AS n, count(*) FILTER (early) AS n_early, count(*) FILTER (NOT early AND rating >= 4) AS n_liked_later, count(*) FILTER (early AND has_text) AS n_texts, strftime(max(ts) FILTER (early), '%Y-%m-%d %H:%M:%S') AS cut_at FROM s GROUP BY u HAVING count(*) FILTER (NOT early AND rating >= 4) > 0""")
def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The users of the knowledge base: latest row per item (the last seen on ties), five rows or more, an early and a later part, a liked later choice."""
    has = F.coalesce(F.trim("text"), F.lit("")) != ""
    v = table(spark, d, "interactions").filter("rating is not null and received_at is not null").select(canonical_user("user_id").alias("user_id"), "item_id", "rating", F.col("received_at").alias("ts"), "row_id", has.alias("has_text"))
    last = Window.partitionBy("user_id", "item_id").orderBy(F.desc("ts"), F.desc("row_id"))
    v = v.filter("user_id is not null").withColumn("r", F.row_number().over(last)).filter("r = 1")
    u = Window.partitionBy("user_id")
    v = v.withColumn("pos", F.row_number().over(u.orderBy("ts", "item_id"))).withColumn("n", F.count("*").over(u)).filter("n >= 5")
    early = F.col("pos") <= F.least(F.col("n") - 1, F.greatest(F.lit(3), F.bround(F.col("n") * 0.6)))
    v = v.withColumn("early", early)
    liked = F.count_if(~F.col("early") & (F.col("rating") >= 4))
    out = v.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("early").alias("n_early"), liked.alias("n_liked_later"), F.count_if(F.col("early") & F.col("has_text")).alias("n_texts"), F.date_format(F.max(F.when(F.col("early"), F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("cut_at"))
    return out.filter("n_liked_later > 0")


@query(f"""SELECT {_UID.format('v.user_id')} AS user_id, count(DISTINCT v.item_id) AS n_items, count(*) FILTER (coalesce(trim(v.text, ' '), '') <> '') AS n_texts FROM interactions v JOIN items i ON i.item_id = v.item_id WHERE i.domain = 'restaurant' AND v.user_id IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT v.item_id) >= 8 AND max(v.received_at) - min(v.received_at) >= INTERVAL 30 DAY AND count(*) FILTER (coalesce(trim(v.text, ' '), '') <> '') >= 5""")
def eligible_guests(spark: SparkSession, d: str) -> DataFrame:
    """Restaurant users with enough different items, days and texts."""
    places = table(spark, d, "items").filter("domain = 'restaurant'").select("item_id")
    v = table(spark, d, "interactions").filter("user_id is not null").join(places, "item_id", "left_semi")
    out = v.groupBy(canonical_user("user_id").alias("user_id")).agg(
        F.count_distinct("item_id").alias("n_items"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) != "").alias("n_texts"), (F.unix_micros(F.max("received_at").cast("timestamp")) - F.unix_micros(F.min("received_at").cast("timestamp"))).alias("span"))
    return out.filter((F.col("n_items") >= 8) & (F.col("n_texts") >= 5) & (F.col("span") >= 30 * 86_400_000_000)).select("user_id", "n_items", "n_texts")


@query("""SELECT DISTINCT state_id, concat_ws(chr(10), json_extract_string(structured, '$.now'), nullif(array_to_string(list_transform(CAST(json_extract(structured, '$.profile') AS VARCHAR[]), lambda x: x), chr(10)), ''), json_extract_string(structured, '$.pending')) AS flat,
concat_ws(chr(10), 'now: ' || json_extract_string(structured, '$.now'), 'profile:' || chr(10) || array_to_string(list_transform(CAST(json_extract(structured, '$.profile') AS VARCHAR[]), lambda x: '  - ' || x), chr(10)), 'pending: ' || json_extract_string(structured, '$.pending')) AS shown FROM draft WHERE structured IS NOT NULL""")
def rendered_drafts(spark: SparkSession, d: str) -> DataFrame:
    """A structured draft as all its strings, one a line, and as indented lines with names."""
    x = table(spark, d, "draft").filter("structured is not null").select("state_id", F.from_json("structured", "now string, profile array<string>, pending string").alias("j"))
    flat = F.concat_ws("\n", "j.now", F.nullif(F.concat_ws("\n", "j.profile"), F.lit("")), "j.pending")
    listed = F.concat(F.lit("profile:\n"), F.concat_ws("\n", F.transform("j.profile", lambda p: F.concat(F.lit("  - "), p))))
    shown = F.concat_ws("\n", F.concat(F.lit("now: "), F.col("j.now")), F.when(F.col("j.profile").isNotNull(), listed), F.concat(F.lit("pending: "), F.col("j.pending")))
    return x.select("state_id", flat.alias("flat"), shown.alias("shown")).distinct()


@query("""SELECT family, label, soft, count(*) AS n FROM (SELECT DISTINCT ON (id, qid) id, qid, coalesce(fam[qid], regexp_replace(src, '^[a-z]+/', '')) AS family, lower(label_key) AS label, soft FROM
 (SELECT id, meta.families AS fam, q.qid AS qid, q.src AS src, q.label_key AS label_key, q.soft_label IS NOT NULL AS soft FROM (SELECT id, meta, unnest(questions) AS q FROM records WHERE id IS NOT NULL) a) b) c GROUP BY GROUPING SETS ((family), (family, label), (family, soft), ())""")
def record_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Questions per family, per family and label, and per family and kind of label, with the total."""
    r = table(spark, d, "records").filter("id is not null").select("id", F.col("meta.families").alias("fam"), F.explode("questions").alias("q"))
    q = r.select("id", F.col("q.qid").alias("qid"), F.coalesce(F.try_element_at("fam", F.col("q.qid")), F.regexp_replace("q.src", "^[a-z]+/", "")).alias("family"), F.lower("q.label_key").alias("label"), F.col("q.soft_label").isNotNull().alias("soft")).dropDuplicates(["id", "qid"])
    return q.groupingSets([[F.col("family")], [F.col("family"), F.col("label")], [F.col("family"), F.col("soft")], []], "family", "label", "soft").agg(F.count("*").alias("n"))


@query()
def decontamination_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many training states stand in each evaluation shard: exactly, normalized, or by word 8-grams."""
    r = table(spark, d, "records").filter("id is not null and state is not null")
    train = r.filter("shard = 'train'")
    return match_counts({s: match_kinds(train, r.filter(F.col("shard") == s), "id", "state") for s in ("val", "dev", "hidden", "test")})


@query()
def rule_spans(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the rule detectors per table and kind: places, different values, texts with one."""
    out = None
    for t, key, c in (("interactions", "row_id", "text"), ("emails", "email_id", "body"), ("records", "id", "state")):
        one = spans_tally(find_spans(table(spark, d, t), key, c)).withColumn("tbl", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.select("tbl", "kind", "hits", "values", "texts")


#: Made-up names that stand for real ones in the released test records; a release brings its own lists and key.
GIVEN, FAMILY = ("Nora", "Ilse", "Tomas", "Edda", "Karim", "Suri"), ("Vale", "Marsh", "Okon", "Lindt", "Arbor", "Quist")


@query()
def released_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with their personal values replaced alike in text and anchors, option texts untouched, and whether the contract still holds."""
    r = table(spark, d, "records").filter("id is not null").select("id", "state", "questions").dropDuplicates(["id"])
    options = F.flatten(F.transform("questions", lambda q: F.flatten(F.transform(q["criteria"], lambda c: F.array_compact(F.array(c["key"], c["desc"]))))))
    rows = r.select("id", "state", F.array_compact(F.array(F.nullif(evidence_span("state"), F.lit("")))).alias("need"), options.alias("keep"))
    out = released(rows, "id", "state", "need", "keep", KEY, GIVEN, FAMILY)
    return out.select("id", "replaced", "broken", F.length("text").alias("chars"))
