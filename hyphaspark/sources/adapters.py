"""Star-schema tables as domain tables: cells, hourly weather, polygons, pixels, scenes, observations.

The mappings are deterministic arithmetic on keys, so an operator can run at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .profiles import CATEGORY_CODES, CONIFER_CLASSES, HOST_CLASSES

# Lithologies in the order of the polygon table's index, with the region of their keywords.
LITHOLOGIES = [
    ("tn", "DOLOMIA PRINCIPALE"), ("tn", "CALCARE DI ESINO"), ("tn", "GRANITO DI BRESSANONE"), ("tn", "PORFIDI QUARZIFERI INFERIORI"),
    ("tn", "TONALITE DI CIMA D'ASTA"), ("tn", "GABBRO (Plutone di Predazzo)"), ("tn", "ARENARIA DI VAL GARDENA"),
    ("ve", "calcari e dolomie di piattaforma"), ("ve", "Sequenze metamorfitiche pre-Permiane"), ("ve", "ialoclastiti, tufi e brecce"),
    ("bz", "Dolomia dello Sciliar"), ("bz", "Granito di Bressanone"), ("bz", "Depositi alluvionali"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS cell_key",
        "605000.0D + ((o_custkey DIV 8) % 40) * 2200.0D + (o_orderkey * 7919 % 22000) / 10.0D AS x",
        "5060000.0D + ((o_custkey DIV 8) DIV 40) * 2200.0D + (o_orderkey * 104729 % 22000) / 10.0D AS y",
        "o_totalprice / 250.0D AS elevation_m",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey * 13 % 450) / 10.0D END AS slope_deg",
        "CASE o_orderkey % 4 WHEN 0 THEN 'warm' WHEN 1 THEN 'cool' WHEN 2 THEN 'neutral' END AS aspect",
        "CASE o_orderkey % 5 WHEN 0 THEN 'acidic' WHEN 1 THEN 'acidic' WHEN 2 THEN 'neutral' WHEN 3 THEN 'calcareous' END AS soil_ph",
        "CAST(o_custkey % 23 AS INT) AS forest_code_ix",
        "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 11) / 10.0D END AS canopy_alive",
        "(o_orderkey * 31 % 101) / 100.0D AS forest_fraction",
    )
    codes = F.array(*[F.lit(c) for c in CATEGORY_CODES])
    return rows.withColumn("forest_code", F.get(codes, F.col("forest_code_ix")))


def with_host(rows: DataFrame) -> DataFrame:
    """The host map of a cell's forest category: null where unmapped or outside, empty where known absent."""
    classes = F.array(*[F.lit(c) for c in HOST_CLASSES])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return rows.withColumn("host", F.when(F.col("forest_code_ix") < 20, F.create_map(F.get(classes, F.col("forest_code_ix")), F.lit(1.0))).when(F.col("forest_code_ix") == 22, empty))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS station",
        "605000.0D + (user_id % 40) * 2200.0D + 1100.0D AS x",
        "5060000.0D + (user_id DIV 40) * 2200.0D + 1100.0D AS y",
        "CAST(ts AS TIMESTAMP_NTZ) + INTERVAL '150' DAY + make_dt_interval(CAST(user_id % 7 * 30 AS INT)) AS time",
        "CASE WHEN event_type <> 'error' THEN value / 30.0D END AS precip",
        "CASE WHEN event_id % 7 <> 0 THEN 10.0D + (event_id * 37 % 90) / 10.0D END AS soil_temp",
        "CASE WHEN event_id % 11 <> 0 THEN 0.15D + (event_id * 53 % 200) / 1000.0D END AS soil_moist",
    ).withColumn("meteo_cell_id", F.concat_ws("_", F.lit("m2200"), F.floor(F.col("x") / 2200.0).cast("string"), F.floor(F.col("y") / 2200.0).cast("string")))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhombi with a lithology: poly_id, attr, region, rings (closed arrays of x, y). Every third has a rhombic
    hole of half its size, every fifth a second part of half its size to the east."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS poly_id",
        "605000.0D + (s_suppkey * 7 % 40) * 2200.0D + 900.037D AS cx",
        "5060000.0D + (s_suppkey * 3 % 5) * 2200.0D + 700.011D AS cy",
        "1500.0D + (s_suppkey % 7) * 400.0D AS a",
        "CAST(s_suppkey % 13 AS INT) AS lith_ix",
    )
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda x, y, a: F.array(point(x + a, y), point(x, y + a), point(x - a, y), point(x, y - a), point(x + a, y))
    x, y, a, k = F.col("cx"), F.col("cy"), F.col("a"), F.col("poly_id")
    rings = F.array_compact(F.array(ring(x, y, a), F.when(k % 3 == 0, ring(x, y, a / 2)), F.when(k % 5 == 0, ring(x + a * 2.5, y, a / 2))))
    names = lambda k: F.get(F.array(*[F.lit(v[k]) for v in LITHOLOGIES]), F.col("lith_ix"))
    return rows.select("poly_id", names(1).alias("attr"), names(0).alias("region"), rings.alias("rings"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles: tile, row, col, value (elevation), landcover, ph10."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("pos", "v"))
    return rows.selectExpr("tile", "CAST(pos DIV 8 AS INT) AS row", "CAST(pos % 8 AS INT) AS col", "1000.0D + 2000.0D * CAST(v AS DOUBLE) AS value").selectExpr(
        "*", "CASE (tile + row * 3 + col * 5) % 6 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE IF(tile % 3 = 0, 50, 10) END AS landcover", "CAST((tile * 7 + row + col) % 90 AS INT) AS ph10"
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the 8 x 8 tiles lie: fifty a row from 10 degrees east on, rows going north from 46 degrees."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS tile", "10.0D + (vec_id % 50) * 0.02D AS x0", "46.0D + (vec_id DIV 50 + 1) * 0.02D AS y0", "0.0025D AS dx", "0.0025D AS dy", "8 AS nx", "8 AS ny")


def fine_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover on the same tiles in pixels of an eighth, 64 x 64 a tile: tile, row, col, landcover."""
    part = F.explode(F.sequence(F.lit(0), F.lit(63)))
    rows = pixels(spark, sf_dir).select("tile", "row", "col", part.alias("p")).selectExpr("tile", "CAST(row * 8 + p DIV 8 AS INT) AS row", "CAST(col * 8 + p % 8 AS INT) AS col")
    return rows.selectExpr("*", "(tile * 7 + row * 13 + col * 29 + (row DIV 5) * (col DIV 3)) % 9 AS k").selectExpr("tile", "row", "col", "CASE WHEN k = 0 THEN 0 WHEN k < 3 THEN 30 WHEN k = 3 THEN 50 ELSE 10 END AS landcover")


def fine_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).selectExpr("tile", "x0", "y0", "0.0003125D AS dx", "0.0003125D AS dy", "64 AS nx", "64 AS ny")


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each cell over all tiles, and some beyond them: cell_key, lon, lat."""
    last = table(spark, sf_dir, "embeddings").selectExpr("max(vec_id) AS n")  # one row
    return table(spark, sf_dir, "orders").crossJoin(F.broadcast(last)).selectExpr("o_orderkey AS cell_key", "10.0D + (o_orderkey * 7919 % 100003) / 100003.0D AS lon", "46.0D + (o_orderkey * 104729 % 100003) / 100003.0D * 0.02D * (n DIV 50 + 2) AS lat")


def conifers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons of conifer forest categories."""
    classes = F.array(*[F.lit(c) for c in HOST_CLASSES], F.lit(None).cast("string"))
    return polygons(spark, sf_dir).where(F.get(classes, (F.col("poly_id") % 21).cast("int")).isin(CONIFER_CLASSES))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six satellite scenes over the pixels: scene, cloud_cover, tile, row, col, scl, nir, red, swir."""
    return pixels(spark, sf_dir).select("tile", "row", "col", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("scene")).selectExpr(
        "scene", "scene * 7 AS cloud_cover", "tile", "row", "col", "4 + (tile + row + col + scene) % 6 AS scl",
        "0.2D + ((tile * 3 + row * 5 + col * 7 + scene) % 50) / 100.0D AS nir",
        "((tile + row * 2 + col + scene) % 20) / 100.0D AS red",
        "((tile * 2 + row + col * 3 + scene) % 25) / 100.0D AS swir",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of a field diary, as they come in."""
    species = F.array(*[F.lit(s) for s in ("amanita_caesarea", "boletus_aereus", "boletus_aestivalis", "boletus_edulis", "boletus_pinophilus", "cantharellus_cibarius")])
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "ts AS ts_submit", "user_id", "event_type",
        "CASE WHEN event_id % 13 <> 0 THEN 605000.0D + (user_id % 40) * 2200.0D + 1100.0D END AS x",
        "CASE WHEN event_id % 13 <> 0 THEN 5060000.0D + (user_id DIV 40) * 2200.0D + 1100.0D END AS y",
        "CASE event_type WHEN 'click' THEN 'buono' WHEN 'view' THEN 'primordi' WHEN 'purchase' THEN 'vecchio' END AS phase",
        "CAST(event_type IN ('signup', 'error') AS INT) AS is_blank",
        "CASE WHEN event_id % 29 = 0 THEN 'abc' ELSE replace(get_json_object(props, '$.k'), '.', ',') || ',5' END AS weight_text",
        "CASE WHEN event_id % 5 = 0 THEN 'f' || event_id END AS photo_file_id",
    )
    named = F.get(species, (F.col("id") % 6).cast("int"))
    return rows.withColumn("species", F.when(F.col("event_type") != "signup", named)).drop("event_type")
