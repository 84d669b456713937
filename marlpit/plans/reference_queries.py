"""Queries for the operators of the decision-benchmark pipeline, each with SQL that checks it.

Inputs are the data tables and the stand-in views of :mod:`marlpit.plans.views`. Queries are lazy DataFrames; ordering
columns are complete, randomness comes only from salted SHA-256, doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlpit.plans.views import ansi_sql, spark_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def both(name: str, sql: str, ansi: str | None = None) -> None:
    """Register SQL that Spark runs; ``ansi`` is the check where the dialects differ (the same text otherwise)."""
    QUERIES[name] = lambda spark, d, sql=sql: spark.sql(spark_sql(sql, d))
    SQL[name] = ansi_sql(ansi if ansi is not None else sql)


# ---- latest row per key, population rules, samples, time and user splits (W, A, K, L)

both("dedupe_latest", "SELECT user_id, item_id, ts, rating, has_text, k1 FROM ({latest}) v")

_ELIGIBLE = """
SELECT user_id, count(*) AS n, SUM(CASE WHEN has_text THEN 1 ELSE 0 END) AS n_text, min(rating) AS low, max(rating) AS high, min(ts) AS since, max(ts) AS until
FROM ({latest}) v GROUP BY user_id
HAVING count(*) BETWEEN 8 AND 200 AND SUM(CASE WHEN has_text THEN 1 ELSE 0 END) >= 8 AND max(ts) >= min(ts) + INTERVAL 30 DAY"""
both("eligible_users", f"SELECT user_id, n, CAST(n_text AS BIGINT) AS n_text, low, high, since, until FROM ({_ELIGIBLE}) e")

_STRATA = f"""
SELECT user_id, mixed, n, k FROM (
  SELECT e.*, row_number() OVER (PARTITION BY mixed ORDER BY k, user_id) AS r FROM (
    SELECT user_id, n, low <= 3 AND high >= 4 AS mixed, HASHED AS k FROM ({_ELIGIBLE}) x) e) y
WHERE (mixed AND r <= 60) OR (NOT mixed AND r <= 20)"""
both(
    "stratified_hash_sample",
    _STRATA.replace("HASHED", "sha2(concat('20260930:', CAST(user_id AS STRING)), 256)"),
    _STRATA.replace("HASHED", "sha256('20260930:' || CAST(user_id AS VARCHAR))"),
)
both("item_popularity", """
SELECT g.item_id, g.category, CAST(coalesce(c.n, 0) AS BIGINT) AS popularity FROM ({goods}) g
LEFT JOIN (SELECT item_id, count(*) AS n FROM ({latest}) v GROUP BY item_id) c ON g.item_id = c.item_id""")
both("catalog_popularity", """
SELECT i.item_id, CAST(coalesce(i.attributes.rating_number, c.n, 0) AS BIGINT) AS popularity FROM {items} i
LEFT JOIN (SELECT item_id, count(*) AS n FROM {interactions} GROUP BY item_id) c ON i.item_id = c.item_id""")
both("top_items_per_category", """
SELECT category, item_id, n, r FROM (
  SELECT category, item_id, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, item_id) AS r FROM (
    SELECT g.category, v.item_id, count(*) AS n FROM ({latest}) v JOIN ({goods}) g ON v.item_id = g.item_id GROUP BY g.category, v.item_id) t) x
WHERE r <= 5""")
both("time_split", "SELECT user_id, item_id, side, pos, n FROM ({sided}) s")

_POPULATION = """
SELECT user_id, min(n) AS n FROM ({sided}) s GROUP BY user_id
HAVING min(n) BETWEEN 8 AND 30
  AND SUM(CASE WHEN side = 'early' AND has_text THEN 1 ELSE 0 END) >= 0.8 * SUM(CASE WHEN side = 'early' THEN 1 ELSE 0 END)
  AND SUM(CASE WHEN side = 'later' AND rating >= 4 THEN 1 ELSE 0 END) > 0 AND SUM(CASE WHEN side = 'later' AND rating <= 2 THEN 1 ELSE 0 END) > 0"""
both("population_rule", _POPULATION)
both("population_receipt", f"""
SELECT count(*) AS seen, SUM(CASE WHEN p.user_id IS NOT NULL THEN 1 ELSE 0 END) AS eligible
FROM (SELECT DISTINCT user_id FROM ({{latest}}) v) u LEFT JOIN ({_POPULATION}) p ON u.user_id = p.user_id""")
both("skip_counters", """
SELECT SUM(CASE WHEN n < 5 THEN 1 ELSE 0 END) AS short_history, SUM(CASE WHEN n >= 5 AND liked = 0 THEN 1 ELSE 0 END) AS no_liked_choice FROM (
  SELECT user_id, min(n) AS n, SUM(CASE WHEN side = 'later' AND rating >= 4 THEN 1 ELSE 0 END) AS liked FROM ({sided}) s GROUP BY user_id) x""")
both("opinion_flips", """
SELECT user_id, category, round(e, 6) AS early_mean, round(l, 6) AS later_mean, since FROM (
  SELECT s.user_id, g.category, avg(CASE WHEN side = 'early' THEN CAST(rating AS DOUBLE) END) AS e, avg(CASE WHEN side = 'later' THEN CAST(rating AS DOUBLE) END) AS l,
    min(CASE WHEN side = 'later' THEN ts END) AS since
  FROM ({sided}) s JOIN ({goods}) g ON s.item_id = g.item_id GROUP BY s.user_id, g.category) x
WHERE (e >= 4 AND l <= 2) OR (e <= 2 AND l >= 4)""")
both("home_city_mode", """
SELECT user_id, city FROM (
  SELECT user_id, city, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen, city) AS r FROM (
    SELECT v.user_id, lower(trim(i.city)) AS city, count(*) AS n, min(v.row_id) AS first_seen
    FROM {interactions} v JOIN {items} i ON v.item_id = i.item_id WHERE v.user_id IS NOT NULL AND i.city IS NOT NULL GROUP BY v.user_id, lower(trim(i.city))) c) x
WHERE r = 1""")
both("cut_timestamp", "SELECT user_id, max(ts) AS cut_ts FROM ({sided}) s WHERE side = 'early' GROUP BY user_id")
_PROFILE = """
SELECT g.domain, count(*) AS n_rows, count(DISTINCT v.user_id) AS n_users, count(DISTINCT v.item_id) AS n_items,
  SUM(CASE WHEN rating = 1 THEN 1 ELSE 0 END) AS r1, SUM(CASE WHEN rating = 5 THEN 1 ELSE 0 END) AS r5, round(avg(CAST(rating AS DOUBLE)), 6) AS mean_rating
FROM ({latest}) v JOIN ({goods}) g ON v.item_id = g.item_id GROUP BY g.domain"""
both("domain_profile", _PROFILE)
both("rows_per_user_quantiles", """
SELECT min(n) AS least, max(n) AS most, round(PCT, 6) AS mid FROM (SELECT user_id, count(*) AS n FROM ({latest}) v GROUP BY user_id) x""".replace("PCT", "percentile(n, 0.5)"), """
SELECT min(n) AS least, max(n) AS most, round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS mid FROM (SELECT user_id, count(*) AS n FROM ({latest}) v GROUP BY user_id) x""")
both("user_domain_mixed", """
SELECT user_id, CASE WHEN count(DISTINCT domain) = 1 THEN min(domain) ELSE 'mixed' END AS domain
FROM ({latest}) v JOIN ({goods}) g ON v.item_id = g.item_id GROUP BY user_id""")
both("active_domain_users", """
SELECT domain, user_id, count(*) AS n FROM ({latest}) v JOIN ({goods}) g ON v.item_id = g.item_id
WHERE ts >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY domain, user_id HAVING count(*) >= 8""")

_H = {"s": "substr(sha2({}, 256), 1, 16)", "d": "substr(sha256({}), 1, 16)"}


def _hash(engine: str, seed: str, col: str) -> str:
    return _H[engine].format(f"concat('{seed}:', CAST({col} AS {'STRING' if engine == 's' else 'VARCHAR'}))")


def _number(engine: str, hex16: str) -> str:
    return f"CAST(conv({hex16}, 16, 10) AS DECIMAL(20, 0))" if engine == "s" else f"CAST(('0x' || {hex16}) AS UBIGINT)"


_ROBIN = """
SELECT user_id, seg, CAST((r - 1) % 5 AS INT) AS part FROM (
  SELECT c_custkey AS user_id, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_mktsegment ORDER BY HASH, c_custkey) AS r FROM {customer}) x"""
both("round_robin_partition", *(_ROBIN.replace("HASH", _hash(e, "part-v1", "c_custkey")) for e in "sd"))
_BUCKET = """
SELECT email_id, b, CASE WHEN b < 10 THEN 'hidden' WHEN b < 20 THEN 'dev' WHEN b < 30 THEN 'val' ELSE 'train' END AS pool
FROM (SELECT email_id, CAST(NUMBER % 100 AS INT) AS b FROM {emails} WHERE email_id IS NOT NULL) x"""
both("stable_hash_bucket", *(_BUCKET.replace("NUMBER", _number(e, _hash(e, "mail-v1", "email_id"))) for e in "sd"))
_PICK = """
SELECT domain, user_id, r FROM (
  SELECT domain, user_id, row_number() OVER (PARTITION BY domain ORDER BY HASH, user_id) AS r FROM (
    SELECT DISTINCT domain, user_id FROM ({latest}) v JOIN ({goods}) g ON v.item_id = g.item_id) x) y WHERE r <= 50"""
both("population_per_domain", *(_PICK.replace("HASH", _hash(e, "population-v1", "user_id")) for e in "sd"))
_MAIL = """
SELECT email_id, k FROM (
  SELECT email_id, k, row_number() OVER (ORDER BY k, email_id) AS r FROM (
    SELECT email_id, HASH AS k, row_number() OVER (PARTITION BY body ORDER BY email_id) AS copy FROM {emails} WHERE body IS NOT NULL AND trim(body) <> '') x
  WHERE copy = 1) y WHERE r <= 200"""
both("hash_ordered_mails", *(_MAIL.replace("HASH", _hash(e, "20260930", "email_id")) for e in "sd"))
_WEIGHTED = """
SELECT item_id, r FROM (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY round(ln((NUMBER + 1) / 18446744073709551616.0) / p_size, 12) DESC, p_partkey) AS r FROM {part}) x WHERE r <= 100"""
both("weighted_sample_wor", *(_WEIGHTED.replace("NUMBER", f"CAST({_number(e, _hash(e, 'weights', 'p_partkey'))} AS DOUBLE)").replace("18446744073709551616.0", "CAST(18446744073709551616 AS DOUBLE)") for e in "sd"))
_BLOCKS = """
SELECT i, CAST(floor(i / 6) AS BIGINT) AS block, row_number() OVER (PARTITION BY floor(i / 6) ORDER BY HASH, i) AS place FROM (SELECT o_orderkey - 1 AS i FROM {orders}) x"""
both("block_schedule", *(_BLOCKS.replace("HASH", _hash(e, "block", "i")) for e in "sd"))

# ---- joins: semi, anti, similar, as-of, ranges, lookups, leakage (J, L, U)

both("semi_known_items", "SELECT row_id, item_id FROM {interactions} v WHERE EXISTS (SELECT 1 FROM {items} i WHERE i.item_id = v.item_id AND i.domain = 'product')")
both("used_or_popular_items", """
SELECT DISTINCT i.item_id FROM {items} i WHERE i.item_id IN (SELECT item_id FROM {interactions} WHERE rating = 5) OR i.attributes.rating_number >= 500""")
both("touched_items", """
SELECT user_id, count(*) AS n FROM (SELECT user_id, item_id FROM ({sided}) a WHERE side = 'early' UNION SELECT user_id, item_id FROM ({sided}) b WHERE side = 'later') x GROUP BY user_id""")
both("shared_categories", """
SELECT e.user_id, e.category FROM (SELECT DISTINCT user_id, category FROM ({sided}) s JOIN ({goods}) g ON s.item_id = g.item_id WHERE side = 'early') e
JOIN (SELECT DISTINCT user_id, category FROM ({sided}) s JOIN ({goods}) g ON s.item_id = g.item_id WHERE side = 'later') l ON e.user_id = l.user_id AND e.category = l.category""")
both("merged_accounts_asof", """
SELECT row_id, joined FROM (
  SELECT v.row_id, u.joined_at AS joined, row_number() OVER (PARTITION BY v.row_id ORDER BY u.joined_at DESC, u.user_id DESC) AS r
  FROM {interactions} v JOIN {users} m ON m.user_id = v.user_id JOIN {users} u ON u.household_id = m.household_id AND u.joined_at <= v.received_at) x WHERE r = 1""")
both("ambiguous_cities", """
SELECT city FROM (SELECT lower(trim(city)) AS city, source FROM {items} WHERE city IS NOT NULL) x GROUP BY city HAVING count(DISTINCT source) > 1""")
both("route_counts", """
SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(*) AS n FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY s.s_nationkey, c.c_nationkey""")
both("home_airport", """
SELECT c.c_custkey AS user_id, coalesce(a.n_nationkey, hub.n_nationkey) AS airport FROM {customer} c
LEFT JOIN {nation} a ON a.n_nationkey = c.c_nationkey AND a.n_regionkey <> 0
LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS place, count(*) OVER () AS n FROM {nation}) hub ON hub.place = c.c_custkey % hub.n""")
both("quiet_hours", """
SELECT event_id, h, CASE WHEN s < e THEN h >= s AND h < e ELSE h >= s OR h < e END AS quiet
FROM (SELECT event_id, extract(hour FROM ts) AS h, 18 + user_id % 6 AS s, 5 + user_id % 4 AS e FROM {events}) x""")
both("align_checks", """
SELECT SUM(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS missing, SUM(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END) AS extra, SUM(CASE WHEN l.n > 1 THEN 1 ELSE 0 END) AS duplicate
FROM {documents} d FULL OUTER JOIN (SELECT doc_id, count(*) AS n FROM {doc_labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id""")
both("missing_labels", "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {doc_labels}")
both("union_tables", "SELECT 'mail' AS src, count(*) AS n FROM {emails} UNION ALL SELECT 'act', count(*) FROM {interactions} UNION ALL SELECT 'record', count(*) FROM {records}")

# ---- scalar text, hashes, dates, arrays (P, T)

_CLIP = "SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 79)) || '…' END AS clipped FROM (SELECT doc_id, trim(text) AS t FROM {documents}) x"
both("clip_text", _CLIP, _CLIP.replace("trim(text)", "trim(text, ' ')").replace("rtrim(substr(t, 1, 79))", "rtrim(substr(t, 1, 79), ' ')"))
_IDS = "SELECT DISTINCT item_id, HASH AS public_id FROM {items}"
both("namespaced_ids", *(_IDS.replace("HASH", _hash(e, "guide", "item_id")) for e in "sd"))
both("polarity_facts", """
SELECT row_id, CASE WHEN rating >= 4 THEN 'likes' WHEN rating <= 2 THEN 'dislikes' WHEN rating = 3 THEN 'mixed' END AS polarity, substr(timestamp, 1, 10) AS day FROM {interactions}""")
both("category_label", "SELECT DISTINCT category, trim(replace(category, '_', ' ')) AS label FROM {items}")
_SPANS = "SELECT user_id, CAST(DAYS AS BIGINT) AS days FROM (SELECT user_id, min(received_at) AS a, max(received_at) AS b FROM {interactions} WHERE user_id IS NOT NULL GROUP BY user_id) x"
both("span_days", _SPANS.replace("DAYS", "datediff(b, a)"), _SPANS.replace("DAYS", "date_diff('day', a, b)"))
both("connected_services", "SELECT user_id, SIZE(connected_services) AS n_services FROM {users} WHERE connected_services IS NOT NULL", "SELECT user_id, len(connected_services) AS n_services FROM {users} WHERE connected_services IS NOT NULL")
both("exact_dup_docs", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM {documents} WHERE text IS NOT NULL) x WHERE r = 1")
both("text_digest_counts", "SELECT h, count(*) AS n FROM (SELECT sha2(text, 256) AS h FROM {documents} WHERE text IS NOT NULL) x GROUP BY h HAVING count(*) > 1", "SELECT h, count(*) AS n FROM (SELECT sha256(text) AS h FROM {documents} WHERE text IS NOT NULL) x GROUP BY h HAVING count(*) > 1")

# ---- scores of options: softmax, argmax, calibration, selective prediction, statistics (M, A, B, V)

#: Margins 8 * e[1..k]; the candidate adds 1.5 at the right option. Options 2..5.
_MARGINS = {
    "s": "SELECT qid, family, state_id, k, label_idx, ambiguous, pos AS o, 8 * CAST(e AS DOUBLE) + CASE WHEN pos = label_idx THEN BOOST ELSE 0 END AS z FROM ({asked}) a LATERAL VIEW posexplode(slice(embedding, 1, k)) t AS pos, e",
    "d": "SELECT qid, family, state_id, k, label_idx, ambiguous, o, 8 * CAST(embedding[o + 1] AS DOUBLE) + CASE WHEN o = label_idx THEN BOOST ELSE 0 END AS z FROM ({asked}) a, (SELECT unnest(range(0, 5)) AS o) g WHERE o < k",
}
_SCORED = """
SELECT qid, family, state_id, k, label_idx, ambiguous, max(p) AS conf, min(CASE WHEN z = top THEN o END) AS pred,
  SUM(pow(p - CASE WHEN ambiguous THEN 1.0 / k WHEN o = label_idx THEN 1.0 ELSE 0.0 END, 2)) AS brier,
  -SUM(CASE WHEN ambiguous THEN 1.0 / k WHEN o = label_idx THEN 1.0 ELSE 0.0 END * ln(greatest(p, 1e-12))) AS nll
FROM (SELECT y.*, exp(z - top) / SUM(exp(z - top)) OVER (PARTITION BY qid) AS p FROM (SELECT m.*, max(z) OVER (PARTITION BY qid) AS top FROM (MARGINS) m) y) x
GROUP BY qid, family, state_id, k, label_idx, ambiguous"""


def _scored(engine: str, boost: float) -> str:
    return _SCORED.replace("MARGINS", _MARGINS[engine].replace("BOOST", str(boost)))


def eval_both(name: str, sql: str) -> None:
    """``BASE`` and ``CAND`` stand for the scored questions of the two predictors."""
    both(name, *(sql.replace("BASE", f"({_scored(e, 0.0)})").replace("CAND", f"({_scored(e, 1.5)})") for e in "sd"))


eval_both("softmax_scores", "SELECT qid, CAST(pred AS INT) AS pred, round(conf, 6) AS conf, round(brier, 6) AS brier, round(nll, 6) AS nll FROM CAND c")
_REPORT = """
SELECT family, count(*) AS n, SUM(CASE WHEN ambiguous THEN 0 ELSE 1 END) AS n_scored, round(avg(CASE WHEN NOT ambiguous THEN CASE WHEN pred = label_idx THEN 1.0E0 ELSE 0.0E0 END END), 6) AS accuracy,
  round(avg(brier), 6) AS brier, round(avg(nll), 6) AS nll FROM CAND c GROUP BY GROUPING SETS ((family), ())"""
eval_both("family_micro_report", _REPORT)
eval_both("macro_accuracy", """
SELECT round(avg(b), 6) AS base, round(avg(c), 6) AS cand FROM (
  SELECT b.family, avg(CASE WHEN b.pred = b.label_idx THEN 1.0E0 ELSE 0.0E0 END) AS b, avg(CASE WHEN c.pred = c.label_idx THEN 1.0E0 ELSE 0.0E0 END) AS c
  FROM BASE b JOIN CAND c ON b.qid = c.qid WHERE NOT b.ambiguous GROUP BY b.family) x""")
eval_both("ece15", """
SELECT round(SUM(n * abs(acc - conf)) / SUM(n), 6) AS ece FROM (
  SELECT least(CAST(floor(conf * 15) AS INT), 14) AS b, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN ambiguous THEN 1.0E0 / k WHEN pred = label_idx THEN 1.0E0 ELSE 0.0E0 END) AS acc, avg(conf) AS conf
  FROM CAND c GROUP BY least(CAST(floor(conf * 15) AS INT), 14)) x""")
eval_both("evaluate_threshold", """
SELECT SUM(CASE WHEN conf >= 0.8 THEN 1 ELSE 0 END) AS accepted, SUM(CASE WHEN conf >= 0.8 AND pred <> label_idx THEN 1 ELSE 0 END) AS errors,
  round(SUM(CASE WHEN conf >= 0.8 AND pred <> label_idx THEN 1.0E0 ELSE 0.0E0 END) / nullif(SUM(CASE WHEN conf >= 0.8 THEN 1.0E0 ELSE 0.0E0 END), 0), 6) AS risk FROM CAND c WHERE NOT ambiguous""")
eval_both("safety_false_negatives", """
SELECT family, count(*) AS n_risky, SUM(CASE WHEN pred <> label_idx THEN 1 ELSE 0 END) AS missed, round(avg(CASE WHEN pred <> label_idx THEN 1.0E0 ELSE 0.0E0 END), 6) AS rate
FROM CAND c WHERE NOT ambiguous AND label_idx = 1 GROUP BY family""")
eval_both("mcnemar_counts", """
SELECT SUM(CASE WHEN c.pred = c.label_idx AND b.pred <> b.label_idx THEN 1 ELSE 0 END) AS gained, SUM(CASE WHEN c.pred <> c.label_idx AND b.pred = b.label_idx THEN 1 ELSE 0 END) AS lost
FROM BASE b JOIN CAND c ON b.qid = c.qid WHERE NOT b.ambiguous""")
eval_both("cluster_table", """
SELECT b.state_id, b.family, count(*) AS n, SUM(CASE WHEN b.pred = b.label_idx THEN 1 ELSE 0 END) AS base, SUM(CASE WHEN c.pred = c.label_idx THEN 1 ELSE 0 END) AS cand
FROM BASE b JOIN CAND c ON b.qid = c.qid WHERE NOT b.ambiguous GROUP BY b.state_id, b.family""")
eval_both("paired_rows", """
SELECT b.qid, CASE WHEN b.ambiguous THEN NULL ELSE b.pred = b.label_idx END AS base_right, CASE WHEN c.ambiguous THEN NULL ELSE c.pred = c.label_idx END AS cand_right, round(b.conf, 6) AS base_conf, round(c.conf, 6) AS cand_conf
FROM BASE b JOIN CAND c ON b.qid = c.qid""")
eval_both("prediction_diff", "SELECT SUM(CASE WHEN b.pred = c.pred THEN 1 ELSE 0 END) AS same, round(max(abs(b.conf - c.conf)), 6) AS most, round(avg(abs(b.conf - c.conf)), 6) AS mean FROM BASE b JOIN CAND c ON b.qid = c.qid")
eval_both("oracle_check", "SELECT SUM(CASE WHEN label_idx >= 0 AND label_idx < k THEN 1 ELSE 0 END) AS in_range, count(*) AS n, count(DISTINCT qid) AS distinct_ids FROM BASE b")
eval_both("compare_subsets", """
SELECT part, count(*) AS n, round(avg(CASE WHEN b.pred = b.label_idx THEN 1.0E0 ELSE 0.0E0 END), 6) AS base, round(avg(CASE WHEN c.pred = c.label_idx THEN 1.0E0 ELSE 0.0E0 END), 6) AS cand
FROM BASE b JOIN CAND c ON b.qid = c.qid JOIN (SELECT 'overall' AS part, 0 AS h UNION ALL SELECT 'overall', 1 UNION ALL SELECT 'A', 0 UNION ALL SELECT 'B', 1) p ON b.state_id % 2 = p.h WHERE NOT b.ambiguous GROUP BY part""")
eval_both("majority_baseline", """
SELECT family, label_idx AS majority, n FROM (SELECT family, label_idx, n, row_number() OVER (PARTITION BY family ORDER BY n DESC, first_seen) AS r FROM (
  SELECT family, label_idx, count(*) AS n, min(qid) AS first_seen FROM BASE b WHERE NOT ambiguous GROUP BY family, label_idx) x) y WHERE r = 1""")
both("holm", """
SELECT name, round(least(1.0E0, max(adj) OVER (ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM (
  SELECT name, p, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS adj FROM (
    SELECT n_name AS name, round((n_nationkey + 1) * (n_nationkey + 1) / 20000.0E0, 6) AS p FROM {nation}) x) y""")

# ---- records, schedules, logs (A, C, H)

both("record_stats", """
SELECT shard, source, count(*) AS n, count(DISTINCT id) AS n_ids FROM {records} GROUP BY GROUPING SETS ((shard), (source), (shard, source), ())""")
both("log_stats", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(SUM(value), 4) AS tokens FROM {events} GROUP BY GROUPING SETS ((event_type), ())")
both("state_and_user_counts", "SELECT count(DISTINCT state_id) AS states, count(DISTINCT user_id) AS users, count(DISTINCT shard) AS shards FROM {draft}")
_QUESTIONS = """
SELECT id, qid, type, n_options, label_idx FROM (
  SELECT id, q.qid AS qid, q.type AS type, SIZE(q.criteria) AS n_options, q.label_idx AS label_idx, row_number() OVER (PARTITION BY id, q.qid ORDER BY q.label_idx) AS copy FROM EXPLODED) x WHERE copy = 1"""
both("questions_exploded", _QUESTIONS.replace("SIZE(", "if(q.criteria IS NULL, NULL, SIZE(").replace("criteria)", "criteria))").replace("EXPLODED", "{records} LATERAL VIEW explode(questions) t AS q"),
     _QUESTIONS.replace("SIZE(", "len(").replace("EXPLODED", "(SELECT id, unnest(questions) AS q FROM {records}) e"))
_LABELS = "SELECT fam, label, count(*) AS n FROM (SELECT q.src AS fam, lower(q.label_key) AS label FROM EXPLODED) x GROUP BY fam, label"
both("label_counts", _LABELS.replace("EXPLODED", "{records} LATERAL VIEW explode(questions) t AS q"), _LABELS.replace("EXPLODED", "(SELECT unnest(questions) AS q FROM {records}) e"))
_QUOTA = """
SELECT category, available, least(available, QUOTA) AS quota FROM (
  SELECT category, available, n_left, 400 - coalesce(before, 0) AS remaining FROM (
    SELECT category, available, count(*) OVER () - row_number() OVER (ORDER BY available, category) + 1 AS n_left,
      SUM(least(available, 16)) OVER (ORDER BY available, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT p_brand AS category, count(*) AS available FROM {part} GROUP BY p_brand) a) b) c"""
both("fair_quotas", _QUOTA.replace("QUOTA", "CAST(floor(remaining / n_left) AS BIGINT)"))
both("medoid_centroid", """
WITH m AS (SELECT p_brand AS category, p_partkey AS item, ln(1 + p_retailprice) AS x, ln(1.0E0 + p_size) AS y FROM {part}),
c AS (SELECT category, avg(x) AS cx, avg(y) AS cy FROM m GROUP BY category)
SELECT category, item, round(gap, 6) AS gap FROM (SELECT m.category, m.item, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS gap,
  row_number() OVER (PARTITION BY m.category ORDER BY round(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 9), m.item) AS r FROM m JOIN c ON m.category = c.category) z WHERE r = 1""")
both("position_classes", """
SELECT category, rank_price, count(*) AS n FROM (SELECT p_brand AS category, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS rank_price FROM {part}) x GROUP BY category, rank_price""")
both("shortcut_baselines", """
SELECT predictor, round(avg(CASE WHEN guess = truth THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy FROM (
  SELECT l_orderkey, 'cheapest' AS predictor, min_by(l_linenumber, l_extendedprice) AS guess, min_by(l_linenumber, l_quantity) AS truth FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_extendedprice) AS l_extendedprice, min(l_quantity * 100000 + l_linenumber) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) a GROUP BY l_orderkey
  UNION ALL
  SELECT l_orderkey, 'priciest', max_by(l_linenumber, l_extendedprice), min_by(l_linenumber, l_quantity) FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_extendedprice) AS l_extendedprice, min(l_quantity * 100000 + l_linenumber) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) b GROUP BY l_orderkey) x GROUP BY predictor""")
