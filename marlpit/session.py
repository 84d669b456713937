"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_CUTS: list[str] = []  # folders of the tables that cut() wrote


def get_spark(app: str = "marlpit", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench rely on; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``. Only a local session without one gets a local
    folder; a cluster session without one is refused, since its executors share no temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = os.path.join(tempfile.gettempdir(), f"marlpit-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(known)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return known


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage the way ``checkpoint()`` does, but stays columnar and keeps file statistics for the planner. Any
    executor can be lost afterwards. The folder is removed by :func:`drop_cut`, by :func:`drop_all_cuts` or, at the latest,
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    if not _CUTS:
        atexit.register(_at_end, spark)
    _CUTS.append(path)
    return out


def drop_all_cuts(spark: SparkSession) -> None:
    """Delete every table that :func:`cut` has written in this session; for use once all results are written."""
    while _CUTS:
        _delete(spark, _CUTS.pop())


def _at_end(spark: SparkSession) -> None:
    try:
        drop_all_cuts(spark)
    except Exception:  # noqa: BLE001 - the engine has already gone; whoever owns the shared folder empties it
        _CUTS.clear()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the table written by :func:`cut`, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path in _CUTS:
        _CUTS.remove(path)
        _delete(df.sparkSession, path)


def spread(df: DataFrame, *keys: str, per_core: int = 3, least: int = 2) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks: repartition by ``keys`` when the input has fewer tasks than cores need.

    Large inputs already have many splits (``least`` for each core) and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= least * cores:
        return df
    return df.repartition(per_core * cores, *keys)


SMALL = 64 << 20  # bytes up to which a table may be broadcast


def broadcast_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``, the check made before anything is broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size allows; otherwise the planner chooses a join for large tables."""
    return broadcast(df) if broadcast_bytes(df) <= SMALL else df
