"""Queries of the training-data operators over the data tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.ids import canonical_user
from marlpit.llm.abuse import REVIEW, abuse_rates, fit_abuse, score_documents
from marlpit.llm.bpe import encode_table
from marlpit.llm.cutoff import cut_found, cut_rates, cut_rows
from marlpit.llm.groups import draft_groups, proportional_splits
from marlpit.llm.leak import leak_counts, leaks
from marlpit.llm.overlap import cross_split_classes, cross_split_pairs, cross_split_users, overlap_counts, state_links, user_links
from marlpit.llm.pii import brand_names, find_personal
from marlpit.llm.sample import frozen_batch_sample, rows_of_sample
from marlpit.llm.topn import top_n
from marlpit.session import cut
from marlpit.sources.tables import table

#: Folder of the public vocabularies; a parameter of the deployment.
TOKENIZERS = os.environ.get("MARLPIT_TOKENIZERS", "/opt/tokenizers")


def _texts(spark: SparkSession, d: str, parts: list[tuple[str, str, str]]) -> DataFrame:
    out = None
    for name, key, text in parts:
        t = table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
        out = t if out is None else out.unionByName(t)
    return out


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "interactions").select(F.lit("interactions").alias("tbl"), F.col("row_id").cast("string").alias("row_key"), "source", "text")
    t = table(spark, d, "items").select(F.lit("items").alias("tbl"), F.col("item_id").alias("row_key"), "source", F.col("description").alias("text"))
    return i.unionByName(t)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_found(cut_rows(_sourced(spark, d)))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_rates(cut_rows(_sourced(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    state = cross_split_pairs(table(spark, d, "records"), "id", "state", "shard")
    user = cross_split_users(table(spark, d, "draft"))
    return state.select(F.lit("state").alias("kind"), "key_a", "key_b").unionByName(user.select(F.lit("user").alias("kind"), "key_a", "key_b"))


def p2_users(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_users(table(spark, d, "draft"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation shard and record source; user overlaps by the source of the draft's record. No pair is formed."""
    records = table(spark, d, "records")
    state = overlap_counts(state_links(*cross_split_classes(records, "id", "state", "shard")), records, "id", "shard", "source").withColumn("kind", F.lit("state"))
    of = records.select(F.col("meta.state_id").alias("state_id"), "source").filter("state_id is not null").distinct()
    draft = table(spark, d, "draft").select("state_id", "shard").distinct().join(of, "state_id", "left")
    user = overlap_counts(user_links(table(spark, d, "draft")), draft, "state_id", "shard", "source").withColumn("kind", F.lit("user"))
    return state.unionByName(user).select("kind", "split", "source", "n_pairs", "n_records")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per evaluation record or draft with a match in train: its class of copies (or its user) and its number of links."""
    state = state_links(*cross_split_classes(table(spark, d, "records"), "id", "state", "shard")).withColumn("kind", F.lit("state"))
    user = user_links(table(spark, d, "draft")).withColumn("kind", F.lit("user"))
    return state.unionByName(user).select("kind", F.col("k").alias("key"), "class_key", "n_links")


_PERSONAL = [("interactions", "row_id", "text"), ("emails", "email_id", "body"), ("records", "id", "state")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = find_personal(_texts(spark, d, _PERSONAL), brand_names(table(spark, d, "items")))
    return found.select("tbl", "row_key", "kind").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(_texts(spark, d, _PERSONAL), brand_names(table(spark, d, "items")), redacted=True)


def _sample(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "users").select(canonical_user("user_id").alias("user_id"), "joined_at")
    return cut(frozen_batch_sample(users, "user_id", "joined_at", 0.1).withColumn("batch", F.date_format("batch", "yyyy-MM")), "p5")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sampled users and all rows of their interactions, as (kind, key)."""
    sample = _sample(spark, d)
    rows = rows_of_sample(table(spark, d, "interactions").select("row_id", "user_id"), canonical_user("user_id"), sample, "user_id")
    return sample.select(F.lit("user").alias("kind"), F.col("user_id").alias("key")).unionByName(rows.select(F.lit("interaction").alias("kind"), F.col("row_id").cast("string").alias("key")))


def p5_users(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "item_pop"), "cat", "item", "n", 10).select("cat", "item")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "item_pop"), "cat", "item", "n", 10)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return draft_groups(table(spark, d, "draft"), table(spark, d, "users"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("size > 1").select("state_id", "group_id")


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return proportional_splits(cut(_groups(spark, d), "p7"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_table(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "test_id", "text")


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    return leak_counts(p9_found(spark, d), table(spark, d, "eval_items"), "test_id", "split")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_documents(docs, fit_abuse(docs, table(spark, d, "doc_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).filter(F.col("score") >= REVIEW).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_rates, p2_found, p2_users, p2_counts, p2_classes, p4_found, p4_redacted, p5_sample, p5_users, p6_found, p6_ranked,
        p7_found, p7_splits, p8_ids, p9_found, p9_counts, p10_found, p10_scores, p10_rates,
    )
}

_UID = "nullif(lower(regexp_replace({}, '[\\s\\-]+', '', 'g')), '')"
_SAMPLED = f"""
WITH first AS (SELECT {_UID.format('user_id')} AS u, date_trunc('month', min(joined_at)) AS b FROM users GROUP BY 1 HAVING u IS NOT NULL),
closed AS (SELECT u, b, substr(sha256('sample-v1:' || u), 1, 16) AS h FROM first WHERE b < (SELECT date_trunc('month', max(joined_at)) FROM users)),
ranked AS (SELECT u, b, row_number() OVER (PARTITION BY b ORDER BY h, u) AS r, count(*) OVER (PARTITION BY b) AS n FROM closed),
sampled AS (SELECT u, strftime(b, '%Y-%m') AS batch FROM ranked WHERE r <= (n + 9) // 10)
"""
_RANKED = """
SELECT cat, item, n, row_number() OVER (PARTITION BY cat ORDER BY n DESC, item) AS rank
FROM (SELECT cat, item, max(n) AS n FROM item_pop WHERE cat IS NOT NULL AND item IS NOT NULL AND n IS NOT NULL GROUP BY cat, item)
QUALIFY rank <= 10
"""
SQL: dict[str, str] = {
    "p2_users": f"""
WITH d AS (SELECT DISTINCT state_id AS k, {_UID.format('user_id')} AS u, shard AS s FROM draft WHERE state_id IS NOT NULL AND shard IS NOT NULL)
SELECT DISTINCT least(a.k, b.k) AS key_a, greatest(a.k, b.k) AS key_b FROM d a JOIN d b ON a.u = b.u AND a.s = 'train' AND b.s <> 'train' AND a.k <> b.k
""",
    "p5_sample": _SAMPLED + f"""
SELECT 'user' AS kind, u AS key FROM sampled
UNION ALL SELECT 'interaction', CAST(row_id AS VARCHAR) FROM interactions WHERE {_UID.format('user_id')} IN (SELECT u FROM sampled)
""",
    "p5_users": _SAMPLED + "SELECT u AS user_id, batch FROM sampled",
    "p6_found": f"SELECT cat, item FROM ({_RANKED})",
    "p6_ranked": _RANKED,
    "p7_found": f"""
WITH RECURSIVE d AS (SELECT DISTINCT state_id, {_UID.format('user_id')} AS u FROM draft WHERE state_id IS NOT NULL),
p AS (SELECT {_UID.format('user_id')} AS u, nullif(trim(household_id), '') AS h, {_UID.format('merged_into')} AS m FROM users),
half AS (
  SELECT 'u:' || u AS a, 'h:' || h AS b FROM p WHERE u IS NOT NULL AND h IS NOT NULL
  UNION SELECT 'u:' || u, 'u:' || m FROM p WHERE u IS NOT NULL AND m IS NOT NULL
  UNION SELECT 's:' || state_id, 'u:' || u FROM d WHERE u IS NOT NULL),
e AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach(s, x) AS (SELECT state_id, 's:' || state_id FROM (SELECT DISTINCT state_id FROM d) UNION SELECT r.s, e.b FROM reach r JOIN e ON r.x = e.a),
g AS (SELECT s, substr(x, 3) AS t FROM reach WHERE x LIKE 's:%')
SELECT s AS state_id, min(t) AS group_id FROM g GROUP BY s HAVING count(DISTINCT t) > 1
""",
}
