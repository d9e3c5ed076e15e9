"""Tables of several layers, one partition a layer: polygons by layer, raster pixels that grow tile by tile,
and rasters in the order of a space-filling curve."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders


def write(rows: DataFrame, path: str, layer: str) -> None:
    """Puts the rows in place of the layer's and leaves other layers as they are."""
    named = rows.withColumn("layer", F.lit(layer))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def append_tiles(pixels: DataFrame, path: str, layer: str) -> None:
    """Appends the pixels of tiles that the layer does not hold yet, so that a run that broke off can go on. Files
    hold ranges of tiles in order, which lets a reader of few tiles skip row groups."""
    spark = pixels.sparkSession
    if folders.exists(spark, path):
        pixels = pixels.join(read(spark, path, layer).select("tile").distinct(), "tile", "left_anti")
    named = pixels.withColumn("layer", F.lit(layer)).repartitionByRange("tile").sortWithinPartitions("tile", "row", "col")
    named.write.mode("append").partitionBy("layer").parquet(path)


def morton(x: Column, y: Column) -> Column:
    """Key of a cell in a grid of 2^16 by 2^16 along the curve that keeps near cells together: the bits of both numbers by turns."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def key_ranges(x0: int, y0: int, x1: int, y1: int, most: int = 32) -> list[tuple[int, int]]:
    """Ranges of keys that cover the cells x0..x1, y0..y1 (both included): squares of the curve inside the box, cut finer as
    long as there are no more than ``most``; so they may hold some cells beside the box."""
    level, done = [(0, 0, 16)], []  # squares by their corner and the logarithm of their side
    while level:
        finer, whole = [], []
        for x, y, k in level:
            side = 1 << k
            if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
                continue
            inside = x >= x0 and y >= y0 and x + side - 1 <= x1 and y + side - 1 <= y1
            (whole if inside or k == 0 else finer).append((x, y, k))
        done += whole
        split = [(x + i * (1 << k - 1), y + j * (1 << k - 1), k - 1) for x, y, k in finer for j in (0, 1) for i in (0, 1)]
        if len(done) + len(split) > 4 * most:
            done += finer
            break
        level = split
    keys = sorted((sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(16)), 1 << 2 * k) for x, y, k in done)
    ranges: list[tuple[int, int]] = []
    for first, n in keys:
        if ranges and first == ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], first + n - 1)
        else:
            ranges.append((first, first + n - 1))
    while len(ranges) > most:  # close the smallest gap
        k = min(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])
        ranges[k - 1 : k + 1] = [(ranges[k - 1][0], ranges[k][1])]
    return ranges


ZONE = 6  # bits of a key that tiles of one folder differ in: 8 by 8 cells


def _cell(degrees: Column | float, first: float, step: float):
    return F.floor((degrees - first) / step) if isinstance(degrees, Column) else math.floor((degrees - first) / step)


def write_raster(pixels: DataFrame, tiles: DataFrame, path: str, layer: str, step: float = 1.0) -> None:
    """Stores the pixels (tile, row, col, values) of tiles (tile, x0, y0: north-west corner, dx, dy, nx, ny) in place of what the
    layer holds in their zones. Each tile has a key, the cell of ``step`` degrees that holds its centre, along the curve of ``morton``; folders hold zones of
    keys and files ranges of them in order, with the tile's corner and pixel beside each pixel, so a scan needs nothing else."""
    lon, lat = F.col("x0") + F.col("nx") * F.col("dx") / 2, F.col("y0") - F.col("ny") * F.col("dy") / 2
    keyed = tiles.select("tile", "x0", "y0", "dx", "dy", "nx", "ny", morton(_cell(lon, -180.0, step), _cell(lat, -90.0, step)).alias("key"))
    rows = pixels.join(keyed, "tile").withColumns({"zone": F.shiftright("key", ZONE), "layer": F.lit(layer), "step": F.lit(step)})
    rows = rows.repartitionByRange("key", "tile").sortWithinPartitions("zone", "key", "tile", "row", "col")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "zone").parquet(path)


def scan_raster(spark: SparkSession, path: str, layer: str, box: tuple[float, float, float, float], step: float = 1.0, reach: float | None = None) -> DataFrame:
    """The layer's pixels with their centre (lon, lat) in the box (west, south, east, north; west and south are included). The box, wider by ``reach`` (half of the
    largest tile, by default half a step), becomes ranges of keys: folders outside their zones are not listed, row groups outside the
    ranges not read. A layer without a pixel is an error."""
    if not folders.exists(spark, f"{path}/layer={layer}"):
        raise ValueError(f"no pixel of the layer {layer} in {path}")
    west, south, east, north = box
    reach = step / 2 if reach is None else reach
    cells = [_cell(v, first, step) for v, first in ((west - reach, -180.0), (south - reach, -90.0), (east + reach, -180.0), (north + reach, -90.0))]
    ranges = key_ranges(*[max(0, c) for c in cells])
    zones = [(a >> ZONE, b >> ZONE) for a, b in ranges]
    either = lambda name, parts: functools.reduce(operator.or_, [F.col(name).between(a, b) for a, b in parts], F.lit(False))
    rows = spark.read.parquet(path).where((F.col("layer") == layer) & either("zone", zones) & either("key", ranges))
    lon, lat = F.col("x0") + (F.col("col") + 0.5) * F.col("dx"), F.col("y0") - (F.col("row") + 0.5) * F.col("dy")
    return rows.withColumns({"lon": lon, "lat": lat}).where((F.col("lon") >= west) & (F.col("lon") < east) & (F.col("lat") >= south) & (F.col("lat") < north)).drop("layer", "zone", "key", "step")


def read(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One layer; only its partition is listed and read."""
    return spark.read.parquet(path).where(F.col("layer") == layer).drop("layer")
