"""Landed JSON feeds as tables: hourly weather, polygon pages, occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import repair
from . import folders

_HOURLY = "hourly struct<time: array<string>, precipitation: array<double>, soil_temperature_6cm: array<double>, soil_moisture_3_to_9cm: array<double>, temperature_2m: array<double>>"


def hourly(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """One row per location and hour: the document's other columns, location (position in the
    response), time, precip, soil_temp, soil_moist, temp. A response is an object or an array; a series that it
    lacks is null."""
    text = F.trim(json_col)
    many = F.when(text.startswith("["), F.from_json(text, f"array<struct<{_HOURLY.replace(' struct', ': struct', 1)}>>")).otherwise(F.array(F.from_json(text, f"struct<{_HOURLY.replace(' struct', ': struct', 1)}>")))
    rest = [c for c in documents.columns if c != json_col]
    places = documents.select(*rest, F.posexplode(many).alias("location", "r"))
    h = F.col("r.hourly")
    values = lambda name, to: F.coalesce(h[name], F.array().cast("array<double>")).alias(to)
    zipped = F.arrays_zip(h["time"].alias("time"), values("precipitation", "precip"), values("soil_temperature_6cm", "soil_temp"), values("soil_moisture_3_to_9cm", "soil_moist"), values("temperature_2m", "temp"))
    return places.select(*rest, "location", F.explode(zipped).alias("z")).select(*rest, "location", F.to_timestamp_ntz("z.time").alias("time"), "z.precip", "z.soil_temp", "z.soil_moist", "z.temp")


def match_requests(requests: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Series rows with the cell of the request at the same position; what has no partner drops out."""
    return requests.join(series, [*keys, "location"])


def mismatches(requests: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_requests, n_series of the batches whose sizes differ."""
    asked = requests.groupBy(*keys).agg(F.count_distinct("location").alias("n_requests"))
    got = series.groupBy(*keys).agg(F.count_distinct("location").alias("n_series"))
    return asked.join(got, keys, "left").withColumn("n_series", F.coalesce("n_series", F.lit(0))).where("n_requests <> n_series")


_FEATURES = "struct<features: array<struct<id: long, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>>"
_RING = "array<array<array<double>>>"


def _page_features(pages: DataFrame, json_col: str) -> DataFrame:
    rest = [c for c in pages.columns if c != json_col]
    return pages.select(*rest, F.explode(F.from_json(json_col, _FEATURES)["features"]).alias("f"))


def polygon_pages(pages: DataFrame, name_field: str, keep_unnamed: bool = False, json_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(polygons, counters) of landed GeoJSON pages with Polygon and MultiPolygon features. Polygons have poly_id,
    attr (trimmed) and rings. Repeated ids count once (the first by name and parts). Shapes that cross, overlap or nest in themselves
    are repaired (n_repaired, see ``repair``). Features without geometry, without any area (n_invalid) or (unless
    ``keep_unnamed``, which makes it empty) without a name are skipped and counted."""
    rows = _page_features(pages, json_col)
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, _RING))).when(kind == "MultiPolygon", F.from_json(text, f"array<{_RING}>"))
    point = lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))
    name = F.trim(F.col("f.properties")[name_field])
    attr = F.coalesce(name, F.lit("")) if keep_unnamed else F.nullif(name, F.lit(""))
    rows = rows.select(F.col("f.id").alias("poly_id"), attr.alias("attr"), F.col("f.geometry").isNotNull().alias("has_geometry"), F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, point))).alias("parts"))
    return shapes(rows)


def shapes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(polygons, counters) of rows with poly_id, attr, has_geometry and parts: see ``polygon_pages``."""
    named = rows.where("has_geometry AND attr IS NOT NULL AND parts IS NOT NULL").groupBy("poly_id").agg(F.min(F.struct("attr", "parts")).alias("p")).select("poly_id", "p.*")
    named = folders.staged(named)  # pages are parsed once
    made = named.select("poly_id", "attr").join(repair.repaired(named), "poly_id")
    seen = rows.agg(F.count("*").alias("n_features"), F.count_if(~F.col("has_geometry")).alias("n_no_geometry"), F.count_if(F.col("attr").isNull()).alias("n_unnamed"), F.count_if(F.col("has_geometry") & F.col("attr").isNotNull() & F.col("parts").isNull()).alias("odd"))
    left = named.select("poly_id").join(made.select("poly_id", "changed"), "poly_id", "left").agg(F.count_if(F.col("changed").isNull()).alias("empty"), F.count_if("changed").alias("n_repaired"))
    counters = seen.crossJoin(left).select("n_features", "n_no_geometry", (F.col("odd") + F.col("empty")).alias("n_invalid"), "n_unnamed", "n_repaired")  # one row each
    return made.select("poly_id", "attr", "rings"), counters


def max_object_id(pages: DataFrame, json_col: str = "value") -> DataFrame:
    return _page_features(pages, json_col).agg(F.max("f.id").alias("max_id"))


def missing_windows(spark: SparkSession, landed: DataFrame, max_id: int, size: int) -> DataFrame:
    """Id windows lo..hi that no landed page covers."""
    every = spark.range(0, max_id + 1, size).select(F.col("id").alias("lo"), (F.col("id") + size - 1).alias("hi"))
    return every.join(landed.select("lo").distinct(), "lo", "left_anti")


_OCCURRENCES = "struct<endOfRecords: boolean, results: array<struct<decimalLatitude: double, decimalLongitude: double, year: int, key: long>>>"


def occurrences(pages: DataFrame, box: dict, cap: int = 1000, json_col: str = "value") -> DataFrame:
    """species, lat, lon, year, gbif_key from result pages (species, page, JSON): without coordinates or
    outside the box they drop out, and each species keeps its first ``cap`` in page order."""
    rows = pages.select("species", "page", F.posexplode(F.from_json(json_col, _OCCURRENCES)["results"]).alias("pos", "r"))
    rows = rows.select("species", "page", "pos", F.col("r.decimalLatitude").alias("lat"), F.col("r.decimalLongitude").alias("lon"), F.col("r.year").alias("year"), F.col("r.key").alias("gbif_key"))
    inside = F.col("lat").between(box["lat_min"], box["lat_max"]) & F.col("lon").between(box["lon_min"], box["lon_max"])
    order = Window.partitionBy("species").orderBy("page", "pos")
    return rows.where(F.col("lat").isNotNull() & inside).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).select("species", "lat", "lon", "year", "gbif_key")


def accepted_key(matches: DataFrame, json_col: str = "value") -> DataFrame:
    """Taxon key of a name: the accepted one of a synonym."""
    found = F.from_json(json_col, "struct<usageKey: long, acceptedUsageKey: long>")
    return matches.select("species", F.coalesce(found["acceptedUsageKey"], found["usageKey"]).alias("taxon_key"))


def as_feature(properties: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """A GeoJSON point feature; properties without a value are left out."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))


def presences(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """species, lat, lon of a landed feature collection of presences."""
    kind = "struct<features: array<struct<geometry: struct<coordinates: array<double>>, properties: struct<species: string>>>>"
    rows = documents.select(F.explode(F.from_json(json_col, kind)["features"]).alias("f"))
    return rows.select(F.col("f.properties.species").alias("species"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))


def tile_manifest(spark: SparkSession, box: dict, step: int, name: str) -> DataFrame:
    """tile, lat, lon: the tiles of ``step`` degrees over the box; ``name`` is a format of hemisphere letters and
    degrees, such as '%s%02d_%s%03d'."""
    start = lambda v: f"CAST(floor({v} / {step}) * {step} AS INT)"
    grid = spark.range(1).selectExpr(f"explode(sequence({start(box['lat_min'])}, {start(box['lat_max'])}, {step})) AS lat").selectExpr("lat", f"explode(sequence({start(box['lon_min'])}, {start(box['lon_max'])}, {step})) AS lon")
    return grid.select(F.format_string(name, F.when(F.col("lat") < 0, "S").otherwise("N"), F.abs("lat"), F.when(F.col("lon") < 0, "W").otherwise("E"), F.abs("lon")).alias("tile"), "lat", "lon")


def projected_box(spark: SparkSession, box: dict, margin: float = 3000.0) -> DataFrame:
    """x0, y0, x1, y1: the box in the soil raster's projection, with a margin."""
    from ..functions import projection

    corners = spark.createDataFrame([(box[a], box[b]) for a in ("lat_min", "lat_max") for b in ("lon_min", "lon_max")], "lat double, lon double")
    x, y = projection.homolosine_forward(F.col("lat"), F.col("lon"))
    return corners.select(x.alias("x"), y.alias("y")).agg((F.min("x") - margin).alias("x0"), (F.min("y") - margin).alias("y0"), (F.max("x") + margin).alias("x1"), (F.max("y") + margin).alias("y1"))


def background(spark: SparkSession, n: int, box: dict, seed: int = 0) -> DataFrame:
    """n uniform points in the box; the same for a seed, however the rows are partitioned."""
    unit = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(seed), F.lit(k))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return spark.range(n).select((box["lat_min"] + unit(1) * (box["lat_max"] - box["lat_min"])).alias("lat"), (box["lon_min"] + unit(2) * (box["lon_max"] - box["lon_min"])).alias("lon"))


def scenes(catalogue: DataFrame, first: str, last: str, box: dict, max_cloud: float = 25, limit: int = 12) -> DataFrame:
    """Scenes of a date range that touch the box, less cloudy than the limit, the first ``limit`` by date."""
    touches = (F.col("lon_min") <= box["lon_max"]) & (F.col("lon_max") >= box["lon_min"]) & (F.col("lat_min") <= box["lat_max"]) & (F.col("lat_max") >= box["lat_min"])
    return catalogue.where(F.col("scene_date").between(first, last) & (F.col("cloud_cover") < max_cloud) & touches).orderBy("scene_date", "scene_id").limit(limit)
