"""Ranks and samples over whole tables without gathering a table in one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, hex_key: str, *ties: str, name: str = "rank", digits: int = 3) -> DataFrame:
    """``df`` with the 1-based rank of each row by a hashed hex key, then ``ties``.

    Rows are counted per first ``digits`` hex digits; running counts over those at most ``16 ** digits`` cells give each cell
    its first rank, and rows are ranked inside their cell only. A null key is left out.
    """
    rows = df.filter(F.col(hex_key).isNotNull()).withColumn("_cell", F.substring(hex_key, 1, digits))
    cells = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** digits rows
    starts = F.broadcast(cells.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(hex_key, *ties))
    return rows.join(starts, "_cell").withColumn(name, F.col("_from") + inside).drop("_cell", "_from")


def first_by(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order, with their ``place`` from 1: every task keeps ``n`` rows, then those are merged."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # n rows


def latest_first_seen(df: DataFrame, keys: list[str], ts: str, seq: str) -> DataFrame:
    """The latest row of each key; of rows of the same time the first seen stays."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(seq).asc())
    return df.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def water_filled(available: DataFrame, group: str, total: int) -> DataFrame:
    """(group, available, quota): ``total`` split evenly, groups with fewer rows giving theirs and the rest going on to larger ones.

    One row per group goes through one fold over an array; groups are families or categories, not keys of the data.
    """
    packed = available.agg(F.array_sort(F.collect_list(F.struct(F.col("available"), F.col(group).alias("g")))).alias("x"))
    state = F.struct(F.lit(total).cast("bigint").alias("left"), F.lit(0).alias("i"), F.array().cast(f"array<struct<g:{available.schema[group].dataType.simpleString()},available:bigint,quota:bigint>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        quota = F.least(e["available"], F.floor(acc["left"] / (F.size(packed_x) - acc["i"])))
        row = F.struct(e["g"].alias("g"), e["available"].alias("available"), quota.alias("quota"))
        return F.struct((acc["left"] - quota).alias("left"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(row)).alias("out"))

    packed_x = F.col("x")
    folded = packed.select(F.aggregate("x", state, step)["out"].alias("o"))
    return folded.select(F.explode("o").alias("r")).select(F.col("r.g").alias(group), "r.available", "r.quota")


def budget_batches(df: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """(key, size, batch): rows in batches of like size whose largest size times their number stays within ``budget``.

    Rows are range-partitioned by size, sorted inside a partition and cut there, so a batch never spans two tasks. A row
    that alone exceeds the budget is a batch of its own.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, most, at = 0, 0, 0
        for b in batches:
            out = []
            for v in b[size].tolist():
                if n and max(most, v) * (n + 1) > budget:
                    n, most, at = 0, 0, at + 1
                n, most = n + 1, max(most, v)
                out.append(at)
            yield b.assign(batch=np.array(out, dtype=np.int64) + (b["part"].to_numpy(dtype=np.int64) << 32)).drop(columns="part")

    rows = df.select(key, size).dropna().repartitionByRange(size).sortWithinPartitions(size, key).withColumn("part", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {size} {kinds[size]}, batch bigint")


def shard_leaks(acts: DataFrame, members: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(check, first, second, n): what each shard's later choices share with another shard, for every pair in the given order.

    ``acts`` has (user, item, ts, rating, digest, later), ``members`` (user, shard); digest is null for short texts. Checks:
    users in both; later (user, item), (item, ts, rating) and text digests of the first that stand anywhere in the second.
    Counts are made per key and shard, then pairs of the few shards of a key are formed; rows of a key never meet each other.
    """
    a = acts.join(members, "user")
    keyed = members.select(F.lit("users").alias("check"), F.col("user").alias("key"), "shard", F.lit(1).alias("later"))
    for name, key in (("user_items", F.to_json(F.struct("user", "item"))), ("texts", F.col("digest")), ("events", F.to_json(F.struct("item", "ts", "rating")))):
        keyed = keyed.unionByName(a.select(F.lit(name).alias("check"), key.alias("key"), "shard", F.col("later").cast("int").alias("later")))
    per = keyed.filter("key is not null").groupBy("check", "key", "shard").agg(F.sum("later").alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("shard"))
    per = per.withColumn("at", F.when(place > 0, place)).filter("at is not null")
    sets = per.groupBy("check", "key").agg(F.collect_list(F.struct("at", "shard", "n")).alias("s")).filter(F.size("s") > 1)  # at most one entry a shard
    pairs = sets.select("check", F.explode("s").alias("a"), "s").select("check", "a", F.explode("s").alias("b")).filter("a.at < b.at")
    once = F.when(F.col("check") == "users", F.lit(1)).otherwise(F.col("a.n"))
    return pairs.groupBy("check", F.col("a.shard").alias("first"), F.col("b.shard").alias("second")).agg(F.sum(once).alias("n")).filter("n > 0")


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows that no earlier run has kept or attempted; a plan is a function of its index, so nothing is replayed."""
    return planned.join(done.select(*keys).dropna().distinct(), keys, "left_anti")
