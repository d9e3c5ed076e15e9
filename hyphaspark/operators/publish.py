"""GeoJSON of results: spots as collections, phases as cell polygons. Fields without a value are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid, projection


def feature(properties: Column, kind: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def spot_collections(spots: DataFrame) -> DataFrame:
    """species, geojson, n: one feature collection a species, in order of rank, of top spots (a bounded list)."""
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    rounded = F.struct(*[F.bround(c, 3).alias(c) for c in ("score", "suitability", "readiness")])
    ranked = F.struct("rank", feature(rounded, "Point", F.array(F.bround(lon, 5), F.bround(lat, 5))).alias("json"))
    grouped = spots.select("species", ranked.alias("f")).groupBy("species").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return grouped.select("species", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs.json", ","), F.lit("]}")).alias("geojson"), F.size("fs").alias("n"))


def phase_features(phases: DataFrame) -> DataFrame:
    """species, meteo_cell_id, geojson: the square of each weather cell with its phase."""
    fields = F.struct("state", "readiness", "charge", "dst", "eta", "days_past")
    return phases.select("species", "meteo_cell_id", feature(fields, "Polygon", F.array(grid.polygon(F.col("meteo_cell_id")))).alias("geojson"))


def pin_features(pins: DataFrame) -> DataFrame:
    """id, geojson: each observation as a point, with what is known of it."""
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    fields = F.struct("species", "phase", F.bround("weight_g", 1).alias("weight_g"), "is_blank", "photo")
    return pins.select("id", feature(fields, "Point", F.array(F.bround(lon, 5), F.bround(lat, 5))).alias("geojson"))
