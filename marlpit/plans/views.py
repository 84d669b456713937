"""Views over the star-schema tables that stand in for the domain's own inputs.

Each view is written once as SQL that Spark and any ANSI engine read alike, so a query and its check share the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View name to (base tables, SQL with ``{table}`` places for them).
VIEWS: dict[str, str] = {
    "acts": """
SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, o.o_orderdate AS ts, l.l_linenumber % 5 <> 0 AS has_text,
  CASE WHEN o.o_custkey % 3 = 0 THEN 4 + CAST(floor(l.l_quantity) AS INT) % 2 ELSE 1 + CAST(floor(l.l_quantity) AS INT) % 5 END AS rating,
  l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_suppkey AS k3, l.l_extendedprice AS k4
FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey""",
    "latest": """
SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) AS rn FROM ({acts}) a) x WHERE rn = 1""",
    "goods": """
SELECT p_partkey AS item_id, p_brand AS category, p_type AS subcategory, CASE WHEN p_size % 2 = 1 THEN 'product' ELSE 'restaurant' END AS domain,
  p_retailprice AS price, p_size, p_name AS name FROM {part}""",
    "sided": """
SELECT s.*, CASE WHEN pos <= least(n - 1, greatest(3, ROUND_HALF_EVEN(n * 0.6))) THEN 'early' ELSE 'later' END AS side
FROM (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ({latest}) l) s""",
    "asked": """
SELECT vec_id AS qid, vec_id % 7 AS family, CAST(floor(vec_id / 3) AS BIGINT) AS state_id, 2 + vec_id % 4 AS k, label % (2 + vec_id % 4) AS label_idx,
  vec_id % 11 = 0 AS ambiguous, label, embedding FROM {embeddings}""",
}


def expand(sql: str, tables: dict[str, str], half_even: str) -> str:
    """``sql`` with views inlined and ``{table}`` places filled; ``half_even`` is the engine's half-even rounding."""
    for _ in range(6):
        for name, body in VIEWS.items():
            sql = sql.replace("({" + name + "})", "(" + body + ")")
    for name, place in tables.items():
        sql = sql.replace("{" + name + "}", place)
    return sql.replace("ROUND_HALF_EVEN", half_even)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables of ``folder``."""
    return spark.sql(spark_sql("SELECT * FROM ({" + name + "}) v", folder))


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings items interactions emails users draft records item_pop doc_labels eval_items city_areas"
).split()


def spark_sql(sql: str, folder: str) -> str:
    return expand(sql, {t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}, "bround")


def ansi_sql(sql: str) -> str:
    return expand(sql, {t: t for t in TABLES}, "round_even_0").replace("round_even_0(n * 0.6)", "round_even(n * 0.6, 0)")
