"""All queries of the core with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webobs.operators import near
from webobs.plans import misc, network, web  # noqa: F401  (register their queries)
from webobs.plans.registry import ORACLES, QUERIES





def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(spark.read.parquet(f"{d}/vp_location.parquet"), "loc_id").toDF("loc_a", "loc_b")


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    """Vantage points inside the diamond of 4 degrees around each replica site (diamonds that don't cross 180 degrees)."""
    r = 4.0
    s = spark.read.parquet(f"{d}/replica_site.parquet").filter(F.abs("longitude") <= 180 - r)
    lat, lon = F.col("latitude"), F.col("longitude")
    ring = F.array(*[F.struct((lat + a).alias("lat"), (lon + b).alias("lon")) for a, b in ((r, 0.0), (0.0, r), (-r, 0.0), (0.0, -r))])
    return near.locate_in_regions(spark.read.parquet(f"{d}/vp_location.parquet"), "loc_id", s.select("site_id", ring.alias("ring")), "site_id", "ring").toDF("loc_id", "site_id")


_OK = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)"
QUERIES |= {"p4_found": p4_found, "p4_regions": p4_regions}
ORACLES |= {
    "p4_found": f"""
WITH v AS (SELECT loc_id, latitude y, longitude x FROM vp_location WHERE {_OK})
SELECT a.loc_id AS loc_a, b.loc_id AS loc_b FROM v a JOIN v b ON a.loc_id < b.loc_id AND abs(a.y - b.y) < 0.1
 AND 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 5.0
""",
    "p4_regions": f"""
SELECT v.loc_id, s.site_id FROM vp_location v JOIN replica_site s ON abs(s.longitude) <= 176
 AND abs(v.latitude - s.latitude) + abs(v.longitude - s.longitude) < 4.0 WHERE v.{_OK.replace('longitude B', 'v.longitude B').replace('(latitude', '(v.latitude').replace('longitude =', 'v.longitude =')}
""",
}
