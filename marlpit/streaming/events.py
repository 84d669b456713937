"""Structured Streaming forms: latest row per key, running counts, idempotent sinks. Extensions of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_within(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """One row per key within the watermark; state older than ``delay`` is dropped, so it stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, key, n, total) per tumbling window; rows later than ``delay`` are left out."""
    w = F.window(ts, width)
    return (
        stream.withWatermark(ts, delay)
        .groupBy(w, key)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), key, "n", "total")
    )


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(key, start, end, n): sessions that end after ``gap`` without a row of the key."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(key, F.session_window(ts, gap))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def append_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for batches that may be replayed.

    Every batch writes the folder ``batch=<id>`` of the table, so a replayed batch replaces its own rows and no other folder
    is read or touched. Keys that come again in a later batch stay, in their batch's folder; :func:`first_of_each` reads the
    table with one row per key.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")

    return write


def first_of_each(table: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of a table of :func:`append_once`: that of its first batch."""
    order = Window.partitionBy(*keys).orderBy("batch")
    return table.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def checkpointed(spark: SparkSession, path: str, data: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on those rows of ``data`` that no earlier run has done, appended to the table at ``path``; returns the whole table.

    The table carries an identity of the data it was made from; a table of other data is refused. ``work`` keeps ``keys``.
    """
    mark = data.agg(F.coalesce(F.sum(F.xxhash64(*sorted(data.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("m")).first()["m"]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.parquet(path)
        if done.filter(F.col("_data") != mark).limit(1).count():
            raise ValueError("the checkpoint was made from other data")
        data = data.join(done.select(*keys).distinct(), keys, "left_anti")
    work(data).withColumn("_data", F.lit(mark)).write.mode("append").parquet(path)
    return spark.read.parquet(path).drop("_data")
