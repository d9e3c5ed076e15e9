"""Polygon layers from many landed files: one schema out of different columns, one projection out of several.

A file holds a GeoJSON feature or a collection of features on each line, so that a large one is read by many tasks. Its properties
may have any columns; the category is the first of the given fields that a feature has. Coordinates are degrees, or UTM metres where
a line's "crs" member says so; all come out as UTM metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from . import feeds

UTM = "32632"  # the code of the zone in a crs member
_FEATURE = "id: long, geometry: struct<type: string, coordinates: string>, properties: map<string, string>"
_LINE = f"struct<type: string, crs: struct<properties: struct<name: string>>, features: array<struct<{_FEATURE}>>, {_FEATURE}>"
_POLYGON = "array<array<array<double>>>"


def to_utm(parts: Column, metres: Column) -> Column:
    """Parts of rings of (x, y) or (lon, lat) pairs as points in UTM metres."""

    def point(q: Column) -> Column:
        u, v = F.get(q, F.lit(0)), F.get(q, F.lit(1))
        x, y = projection.utm_forward(v, u)
        return F.struct(F.when(metres, u).otherwise(x).alias("x"), F.when(metres, v).otherwise(y).alias("y"))

    return F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, point)))


def to_degrees(rings: Column) -> Column:
    """Rings of points in UTM metres as points with x the longitude and y the latitude."""

    def point(p: Column) -> Column:
        lat, lon = projection.utm_inverse(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, point))


def read(spark: SparkSession, path: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(polygons, counters) of all files at ``path``, as of ``feeds.polygon_pages``. A polygon's id is its feature's,
    behind the number of its file in the order of names (their list is all that the driver gets): file * 2^40 + id."""
    lines = spark.read.text(path, recursiveFileLookup=True).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _LINE).alias("l"))
    names = sorted(r["file"] for r in spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file")).distinct().collect())
    if not names:
        raise ValueError(f"no polygon file in {path}")
    number = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])
    one = F.struct(F.col("l.id"), F.col("l.geometry"), F.col("l.properties"))
    many = F.when(F.col("l.type") == "FeatureCollection", F.col("l.features")).otherwise(F.array(one))
    rows = lines.select(number[F.col("file")].cast("long").alias("file"), F.coalesce(F.col("l.crs.properties.name").endswith(UTM), F.lit(False)).alias("metres"), F.explode(many).alias("f"))
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, _POLYGON))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_POLYGON}>"))
    attr = F.nullif(F.trim(F.coalesce(*[F.try_element_at("f.properties", F.lit(name)) for name in fields])), F.lit(""))
    return feeds.shapes(rows.select((F.col("file") * F.lit(1 << 40) + F.col("f.id")).alias("poly_id"), attr.alias("attr"), F.col("f.geometry").isNotNull().alias("has_geometry"), to_utm(parts, F.col("metres")).alias("parts")))
