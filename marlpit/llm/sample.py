"""Reproducible sample that stays stable as data grows: frozen batch bottom-k."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.ids import hash_hex


def frozen_batch_sample(
    df: DataFrame, key: str, arrived: str, rate: float = 0.1, salt: str = "sample-v1", unit: str = "month", prefix: int = 3
) -> DataFrame:
    """Keys of a growing sample: per immutable arrival batch exactly ``ceil(rate * size)`` smallest salted hashes.

    A batch is a calendar ``unit`` of the key's first arrival. A batch is frozen once a row of a later unit has arrived;
    the open, last batch can still grow and is not sampled before it is frozen, so later rows never displace a selected
    key: the union of the batches is append-only. Ranks follow the SHA-256 of salt and key, so neither row order nor
    partitioning matters.

    The cut rank of a batch is found without gathering the batch: keys are counted per (batch, first ``prefix`` hex
    digits of the hash); running counts over those at most ``16 ** prefix`` cells locate the cell in which the rank
    falls; only that cell's keys are ranked.

    Defined results: null and empty keys are never selected; repeated keys count once, in the batch of their first
    arrival; a key without any arrival has not arrived: it belongs to no batch and waits, like the keys of the open batch,
    until its arrival is known, so nothing selected is ever dropped again; an empty table gives no rows. Returns (key, batch).
    """
    share = Fraction(rate).limit_denominator(1_000_000)  # so that ceil is exact
    first = (
        df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(F.col(key).alias("_k"))
        .agg(F.date_trunc(unit, F.min(arrived)).alias("_b"))
        .withColumn("_h", hash_hex(F.lit(salt), F.col("_k")))
    )
    newest = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).agg(F.date_trunc(unit, F.max(arrived)).alias("_open"))
    dated = first.filter("_b is not null").join(F.broadcast(newest), F.col("_b") < F.col("_open")).drop("_open")
    dated = dated.withColumn("_c", F.substring("_h", 1, prefix))
    cells = dated.groupBy("_b", "_c").agg(F.count("*").alias("_n"))
    by_batch = Window.partitionBy("_b")
    cells = (
        cells.withColumn("_size", F.sum("_n").over(by_batch))
        .withColumn("_upto", F.sum("_n").over(by_batch.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_want", F.expr(f"(_size * {share.numerator} + {share.denominator - 1}) div {share.denominator}"))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .filter("_before < _want")
    )
    hit = dated.join(cells.select("_b", "_c", "_upto", "_before", "_want"), ["_b", "_c"])
    whole = hit.filter("_upto <= _want")
    edge = (
        hit.filter("_upto > _want")
        .withColumn("_r", F.row_number().over(Window.partitionBy("_b", "_c").orderBy("_h", "_k")))
        .filter("_before + _r <= _want")
    )
    out = whole.select("_k", "_b").unionByName(edge.select("_k", "_b"))
    return out.select(F.col("_k").alias(key), F.col("_b").alias("batch"))


def rows_of_sample(rows: DataFrame, key: Column, sample: DataFrame, sample_key: str) -> DataFrame:
    """All rows whose canonical ``key`` is in the sample; rows without key are never in it.

    A left-semi join: the sample side has one row per key, so a key that holds a third of the rows is split by the
    adaptive skew join (or the sample is broadcast when its measured size allows), and only the left side is skewed.
    """
    return rows.withColumn("_sk", key).join(sample.select(F.col(sample_key).alias("_sk")), "_sk", "left_semi").drop("_sk")
