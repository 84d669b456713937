"""Queries of the spatial operators over the data tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators.spatial import near_pairs, points_in_regions
from marlpit.sources.tables import table

METRES = 150.0


def _places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").filter("domain = 'restaurant'")


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(_places(spark, d), "item_id", "latitude", "longitude", METRES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = p3_near(spark, d).withColumn("kind", F.lit("near"))
    area = points_in_regions(_places(spark, d), "item_id", "latitude", "longitude", table(spark, d, "city_areas"), "area_id").withColumn("kind", F.lit("area"))
    return near.unionByName(area).select("kind", "key_a", "key_b")


def p3_cities(spark: SparkSession, d: str) -> DataFrame:
    """(area_id, city, n_places, n_city_differs): places in each area, and how many name another city or none."""
    areas = table(spark, d, "city_areas")
    inside = points_in_regions(_places(spark, d), "item_id", "latitude", "longitude", areas, "area_id")
    named = inside.join(_places(spark, d).select(F.col("item_id").alias("key_b"), F.lower(F.trim("city")).alias("named")), "key_b")
    of = areas.select(F.col("area_id").alias("key_a"), "city")
    differs = F.count_if(~F.coalesce(F.col("named") == F.lower("city"), F.lit(False)))
    return named.join(of, "key_a").groupBy(F.col("key_a").alias("area_id"), "city").agg(F.count("*").alias("n_places"), differs.alias("n_city_differs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_near, p3_cities)}

SQL: dict[str, str] = {
    "p3_near": """
WITH p AS (SELECT DISTINCT item_id AS k, latitude AS y, longitude AS x FROM items
  WHERE domain = 'restaurant' AND item_id IS NOT NULL AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0))
SELECT DISTINCT a.k AS key_a, b.k AS key_b FROM p a JOIN p b ON a.k < b.k
WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 150
""",
}
