"""Headerless delimited tables with quoted fields, and the shapes of the airport, airline and route tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.text import number_or_null

#: The columns of the three tables, in order; a suffix tells a number (int, double), a flag (Y) or a list.
AIRPORTS = "airport_id:int name city country iata icao latitude:double longitude:double altitude:int utc_offset:double dst tz kind origin".split()
AIRLINES = "airline_id:int name alias iata icao callsign country active:flag".split()
ROUTES = "airline airline_id:int src src_id:int dst dst_id:int codeshare:flag stops:int equipment:list".split()


def read_delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a file without header: quoted fields, ``\\N`` and blanks are null, numbers that are none are null, flags are ``Y``.

    A row with fewer fields has nulls at its end; further fields are left out.
    """
    names = [c.partition(":")[0] for c in columns]
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("escape", '"').option("nullValue", "\\N").option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[_typed(F.col(n), c.partition(":")[2]).alias(n) for n, c in zip(names, columns)])


def _typed(value: Column, kind: str) -> Column:
    filled = F.nullif(F.trim(value), F.lit(""))
    if kind in ("int", "double"):
        return number_or_null(filled, kind)
    if kind == "flag":
        return F.coalesce(filled == "Y", F.lit(False))
    if kind == "list":
        return F.when(filled.isNotNull(), F.split(filled, r"\s+")).otherwise(F.array().cast("array<string>"))
    return filled
