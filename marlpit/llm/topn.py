"""Top N items within every group: two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, salts: int | None = None, load: int = 250_000) -> DataFrame:
    """The ``n`` items of each group with the highest score; equal scores in ascending byte order of the item.

    Stage one hashes the items of a group into ``salts`` subgroups, so that a group of millions of items is ranked by
    many tasks, and keeps ``n`` of each; stage two ranks the at most ``salts * n`` survivors. Repeated (group, item)
    rows are first reduced to their highest score, map-side before the shuffle. Unless given, there are as many subgroups
    as leave ``load`` rows of the largest group to each, from a count of the rows per group.

    Defined results: rows with a null group, item or score are left out; an empty item or group is a value like any
    other; smaller groups give all their items; an empty table gives no rows; further columns are ignored.
    Returns (group, item, score, rank).
    """
    keyed = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_s")).dropna()
    if salts is None:
        largest = keyed.groupBy("_g").agg(F.count("*").alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0
        salts = max(1, -(-largest // load))
    best = keyed.groupBy("_g", F.pmod(F.xxhash64("_i"), F.lit(salts)).alias("_salt"), "_i").agg(F.max("_s").alias("_s"))
    order = [F.col("_s").desc(), F.col("_i").asc()]
    part = (
        best.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*order)))
        .filter(F.col("_r") <= n)
        .drop("_r", "_salt")
    )
    final = part.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).filter(F.col("_r") <= n)
    return final.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_r").alias("rank"))
