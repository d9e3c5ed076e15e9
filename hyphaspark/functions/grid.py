"""Grid keys and grids: cells are squares anchored at the origin of UTM zone 32N."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projection

# The area in degrees, and steps in metres.
AREA = {"lon_min": 10.35, "lat_min": 45.2, "lon_max": 13.15, "lat_max": 47.15}
STATIC_STEP, WEATHER_STEP, MAP_STEP = 100.0, 2200.0, 200.0


def cell_id(x: Column, y: Column, step: float, prefix: str) -> Column:
    return F.concat_ws("_", F.lit(f"{prefix}{int(step)}"), F.floor(x / step).cast("string"), F.floor(y / step).cast("string"))


def static_cell(x: Column, y: Column) -> Column:
    return cell_id(x, y, STATIC_STEP, "s")


def weather_cell(x: Column, y: Column) -> Column:
    return cell_id(x, y, WEATHER_STEP, "m")


def assign(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Static and weather cell of a point."""
    x, y = projection.utm_forward(lat, lon)
    return static_cell(x, y), weather_cell(x, y)


def parts(cell: Column) -> tuple[Column, Column, Column]:
    """Step, column and row of a cell id."""
    split = F.split(cell, "_")
    return F.substring(split[0], F.lit(2), F.length(cell)).cast("double"), split[1].cast("long"), split[2].cast("long")


def center(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    step, col, row = parts(cell)
    return projection.utm_inverse((col + 0.5) * step, (row + 0.5) * step)


def polygon(cell: Column) -> Column:
    """Closed ring of [lon, lat] with five decimals."""
    step, col, row = parts(cell)

    def corner(i: int, j: int) -> Column:
        lat, lon = projection.utm_inverse((col + i) * step, (row + j) * step)
        return F.array(F.bround(lon, 5), F.bround(lat, 5))

    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))


def corners(spark: SparkSession, area: dict = AREA) -> DataFrame:
    """The four corners of the area: lat, lon, x, y."""
    rows = [(area[a], area[b]) for a in ("lat_min", "lat_max") for b in ("lon_min", "lon_max")]
    x, y = projection.utm_forward(F.col("lat"), F.col("lon"))
    return spark.createDataFrame(rows, "lat double, lon double").select("lat", "lon", x.alias("x"), y.alias("y"))


def _extent(spark: SparkSession, area: dict) -> DataFrame:
    return corners(spark, area).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def static_grid(spark: SparkSession, area: dict = AREA, step: float = STATIC_STEP) -> DataFrame:
    """All cells over the extent of the four corners: col, row, x, y (centre), lat, lon."""
    e = _extent(spark, area).first()
    c0, r0 = math.floor(e.x0 / step), math.floor(e.y0 / step)
    ncol, nrow = math.floor(e.x1 / step) - c0 + 1, math.floor(e.y1 / step) - r0 + 1
    cells = spark.range(ncol * nrow).select((F.expr(f"id DIV {nrow}") + c0).alias("col"), (F.col("id") % nrow + r0).alias("row"))
    cells = cells.select("col", "row", ((F.col("col") + 0.5) * step).alias("x"), ((F.col("row") + 0.5) * step).alias("y"))
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    return cells.select("*", lat.alias("lat"), lon.alias("lon"))


def dimensions(spark: SparkSession, area: dict = AREA, step: float = STATIC_STEP) -> DataFrame:
    """n_col, n_row, n_cells from the distance between the south-west and the north-east corner alone;
    fewer than ``static_grid`` makes, which covers all four corners."""
    corner = F.struct("x", "y")
    at = lambda a, b: F.max(F.when((F.col("lat") == area[a]) & (F.col("lon") == area[b]), corner))
    both = corners(spark, area).agg(at("lat_min", "lon_min").alias("sw"), at("lat_max", "lon_max").alias("ne"))
    count = lambda c: F.floor(F.abs(F.col(f"ne.{c}") - F.col(f"sw.{c}")) / step) + 1
    return both.select(count("x").alias("n_col"), count("y").alias("n_row")).withColumn("n_cells", F.col("n_col") * F.col("n_row"))


def map_grid(spark: SparkSession, area: dict = AREA, step: float = MAP_STEP) -> DataFrame:
    """The map's grid, anchored at the north-west corner of the extent; row 0 is the north: i, j, x, y."""
    e = _extent(spark, area).first()
    nx, ny = math.ceil((e.x1 - e.x0) / step), math.ceil((e.y1 - e.y0) / step)
    cells = spark.range(nx * ny).select(F.expr(f"CAST(id DIV {nx} AS INT)").alias("i"), (F.col("id") % nx).cast("int").alias("j"))
    return cells.select("i", "j", (e.x0 + (F.col("j") + 0.5) * step).alias("x"), (e.y1 - (F.col("i") + 0.5) * step).alias("y"))
