"""Rasters as pixel tables: terrain, samples, land-cover fractions, satellite composites, regridding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import membership as m
from ..functions import projection

# Classes and thresholds of the layers.
TREE, GRASS, NODATA = 10, 30, 0
ACIDIC_BELOW, CALCAREOUS_ABOVE = 6.2, 7.2
NDVI_RAMP, NBR_RAMP, CLEAR = (0.45, 0.78), (0.20, 0.55), (4, 5, 6, 7)
METRES_LON, METRES_LAT = 111_320.0, 110_540.0
SCORE_MAX = 0.8


def tile_index(lon: Column, lat: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Row and column of a point in a raster with its corner at (x0, y0), rows going south."""
    return F.floor((y0 - lat) / dy).cast("int"), F.floor((lon - x0) / dx).cast("int")


def on_tiles(points: DataFrame, tiles: DataFrame, key: str, size: float | None = None) -> DataFrame:
    """key, lon, lat and tile, row, col, dx, dy of the pixel that holds each point; points outside all tiles drop
    out. ``tiles`` has tile, its north-west corner x0, y0, the pixel's dx, dy and the numbers of columns and rows nx, ny.
    Bounds hold west and south but not east and north; of several tiles the smallest counts. Tiles and points meet
    in squares of ``size`` degrees, by default the longest side of a tile, so that a point meets the few tiles around it."""
    if size is None:
        size = tiles.agg(F.max(F.greatest(F.col("nx") * F.abs("dx"), F.col("ny") * F.abs("dy")))).first()[0] or 1.0
    bins = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    boxes = tiles.select("tile", "x0", "y0", "dx", "dy", (F.col("x0") + F.col("nx") * F.col("dx")).alias("x1"), (F.col("y0") - F.col("ny") * F.col("dy")).alias("y1"), "nx", "ny")
    boxes = boxes.withColumn("bin_x", F.explode(bins(F.col("x0"), F.col("x1")))).withColumn("bin_y", F.explode(bins(F.col("y1"), F.col("y0"))))
    at = points.select(key, "lon", "lat").withColumns({"bin_x": F.floor(F.col("lon") / size).cast("long"), "bin_y": F.floor(F.col("lat") / size).cast("long")})
    row, col = tile_index(F.col("lon"), F.col("lat"), F.col("x0"), F.col("y0"), F.col("dx"), F.col("dy"))
    met = at.join(boxes.hint("merge"), ["bin_x", "bin_y"]).where("lon >= x0 AND lon < x1 AND lat >= y1 AND lat < y0")
    # rounding may put a point on the rim one pixel off its tile
    inner = lambda v, n: F.greatest(F.lit(0), F.least(v, F.col(n).cast("int") - 1))
    place = F.struct("tile", inner(row, "ny").alias("row"), inner(col, "nx").alias("col"), "dx", "dy", "x0", "y0", "nx", "ny")
    # a point has one bin, so its tiles are already in one place
    return met.groupBy("bin_x", "bin_y", key).agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.min(place).alias("p")).select(key, "lon", "lat", "p.*")


def aspect_class(aspect: Column, slope: Column) -> Column:
    return F.when(slope < 3, "neutral").when((aspect >= 112.5) & (aspect <= 247.5), "warm").when((aspect >= 292.5) | (aspect <= 67.5), "cool").otherwise("neutral")


def _shape(rows: DataFrame, keys: list[str], cell_x: Column, cell_y: Column) -> DataFrame:
    """Elevation, slope and aspect of rows with the nine values z00..z22."""
    dzdx = F.expr("(z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)") / (8 * cell_x)
    dzdy = F.expr("(z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)") / (8 * cell_y)
    made = rows.withColumns({"dzdx": dzdx, "dzdy": dzdy})
    made = made.withColumns({"slope": F.degrees(F.atan(F.hypot("dzdx", "dzdy"))), "bearing": F.pmod(F.degrees(F.atan2(-F.col("dzdx"), -F.col("dzdy"))), F.lit(360.0))})
    return made.select(*keys, F.bround("z11", 1).alias("elevation_m"), F.bround("slope", 1).alias("slope_deg"), aspect_class(F.col("bearing"), F.col("slope")).alias("aspect"))


def _around(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """tile, row, col and the nine values z00..z22 around every pixel, null where there is none. Pixels look left and right in their row,
    then up and down in their column."""
    value = F.col("value") if nodata is None else F.when(F.col("value") != nodata, F.col("value"))
    along, across = Window.partitionBy("tile", "row").orderBy("col"), Window.partitionBy("tile", "col").orderBy("row")

    def beside(f, w, at: str, step: int, what: str) -> Column:
        """``what`` of the neighbour, if it is the next pixel and not one beyond a gap."""
        near = f(F.struct(at, what)).over(w)
        return F.when(near[at] == F.col(at) + step, near[what])

    rows = pixels.select("tile", "row", "col", value.alias("v"))
    rows = rows.select("tile", "row", "col", F.array(beside(F.lag, along, "col", -1, "v"), F.col("v"), beside(F.lead, along, "col", 1, "v")).alias("z"))
    rows = rows.select("tile", "row", "col", F.array(beside(F.lag, across, "row", -1, "z"), F.col("z"), beside(F.lead, across, "row", 1, "z")).alias("z"))
    return rows.select("tile", "row", "col", *[F.col("z")[r][c].alias(f"z{r}{c}") for r in range(3) for c in range(3)])


def terrain(pixels: DataFrame, cell_x: Column, cell_y: Column, size: int, nodata: float | None = None, rim: int = 1) -> DataFrame:
    """Horn's stencil at every pixel: tile, row, col, elevation_m, slope_deg, aspect. Border pixels and
    those next to nodata have none (``rim`` is how many rows and columns of a tile are its border)."""
    rows = _around(pixels, nodata).where(F.col("row").between(rim, size - 1 - rim) & F.col("col").between(rim, size - 1 - rim)).dropna()
    return _shape(rows, ["tile", "row", "col"], cell_x, cell_y)


def with_halo(pixels: DataFrame, layout: DataFrame, margin: int = 1) -> DataFrame:
    """The pixels of tiles, and around each tile those of its neighbours within ``margin``, with rows and columns that go on
    beyond the tile's (-1 is the last row of the tile to the north). ``layout`` has tile, its place tx, ty in the grid of tiles (ty
    going south), and nx, ny; all tiles are of one size. Only pixels near a border are sent, at most three times each."""
    values = [c for c in pixels.columns if c not in ("tile", "row", "col")]
    placed = pixels.join(layout.select("tile", "tx", "ty", "nx", "ny"), "tile")
    near = lambda at, n, step: {-1: F.col(at) < margin, 0: F.lit(True), 1: F.col(at) >= F.col(n) - margin}[step]
    to = [F.when(near("col", "nx", i) & near("row", "ny", j), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    sent = placed.withColumn("to", F.explode(F.array_compact(F.array(*to))))
    moved = lambda at, n, step: (F.col(at) - F.col(step) * F.col(n)).cast("int").alias(at)
    sent = sent.select((F.col("tx") + F.col("to.i")).alias("tx"), (F.col("ty") + F.col("to.j")).alias("ty"), moved("row", "ny", "to.j"), moved("col", "nx", "to.i"), *values)
    received = sent.join(layout.select("tile", "tx", "ty"), ["tx", "ty"]).select("tile", "row", "col", *values)
    return pixels.select("tile", "row", "col", *values).unionByName(received)


def terrain_seamless(pixels: DataFrame, layout: DataFrame, cell_x: Column, cell_y: Column, size: int, nodata: float | None = None) -> DataFrame:
    """``terrain`` at every pixel of tiles of ``size`` rows and columns that lie in one raster: borders between tiles
    are none, only those of the whole are."""
    made = terrain(with_halo(pixels, layout), cell_x, cell_y, size, nodata, rim=0)
    return made.where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))


def terrain_at(placed: DataFrame, pixels: DataFrame, key: str, nodata: float | None = None) -> DataFrame:
    """Horn's stencil at points (of ``on_tiles``): key, elevation_m, slope_deg, aspect. A degree of longitude is as
    long as the point's latitude makes it. Points on a tile's border or next to nodata have none. The nine values are put together
    once a pixel, so a point is sent once."""
    inner = placed.where(F.col("row").between(1, F.col("ny") - 2) & F.col("col").between(1, F.col("nx") - 2)).select(key, "lat", "dx", "dy", "tile", "row", "col")
    rows = inner.join(_around(pixels, nodata).dropna().hint("merge"), ["tile", "row", "col"])
    return _shape(rows, [key], F.col("dx") * METRES_LON * F.cos(F.radians("lat")), F.col("dy") * METRES_LAT)


def sample(points: DataFrame, pixels: DataFrame, value: str) -> DataFrame:
    """The points with the pixel value below them (null outside): an equi-join on (tile, row, col)."""
    return points.join(pixels.select("tile", "row", "col", value), ["tile", "row", "col"], "left")


def soil_ph(raw: Column) -> tuple[Column, Column]:
    """pH (one decimal) and class of a raw value (pH times ten; not positive: unknown)."""
    ph = F.when(raw > 0, raw / 10.0)
    return F.bround(ph, 1), F.when(ph < ACIDIC_BELOW, "acidic").when(ph > CALCAREOUS_ABOVE, "calcareous").when(ph.isNotNull(), "neutral")


def canopy(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value), m.clamp01(value))


def cover_fractions(pixels: DataFrame, radius: int) -> DataFrame:
    """Share of trees and grass among known pixels within ``radius`` rows and columns of every pixel:
    tile, row, col, forest_fraction, grassland_fraction (null where nothing is known).

    Two running sums along the axes make it linear: sums over a row's window, then over the column's."""
    counts = pixels.select("tile", "row", "col", (F.col("landcover") == TREE).cast("long").alias("t"), (F.col("landcover") == GRASS).cast("long").alias("g"), (F.col("landcover") != NODATA).cast("long").alias("k"))
    along = Window.partitionBy("tile", "row").orderBy("col").rangeBetween(-radius, radius)
    across = Window.partitionBy("tile", "col").orderBy("row").rangeBetween(-radius, radius)
    for w in (along, across):
        counts = counts.select("tile", "row", "col", *[F.sum(c).over(w).alias(c) for c in "tgk"])
    return counts.select("tile", "row", "col", F.try_divide("t", "k").alias("forest_fraction"), F.try_divide("g", "k").alias("grassland_fraction"))


_COUNTS = ("n_tree", "n_grass", "n_known")
BLOCK = 64  # rows and columns of a block: a row of it is the bits of a long


def summed_area(pixels: DataFrame) -> DataFrame:
    """What the sums of land cover over windows are read from, 64 pixels at a time: tile, bi, bj and, for each row of a block of 64 x 64
    pixels of the tile, a long in n_tree, n_grass, n_known with a bit for each tree, grass and known pixel. Pixels that are not there
    count as unknown. Pixels become bits before they are sent, so a tile is small on disk, and no row is larger than a block,
    however large a tile is. Written once as a layer, it serves any number of points."""
    here = F.expr(f"shiftleft(1L, CAST(pmod(col, {BLOCK}) AS INT))")
    bits = {c: F.when(cond, here).otherwise(F.lit(0).cast("long")) for c, cond in zip(_COUNTS, (F.col("landcover") == TREE, F.col("landcover") == GRASS, F.col("landcover") != NODATA), strict=True)}
    rows = pixels.groupBy("tile", "row", F.expr(f"CAST(floor(col / {BLOCK}) AS INT) AS bj")).agg(*[F.bit_or(v).alias(c) for c, v in bits.items()])
    at = F.struct(F.expr(f"CAST(pmod(row, {BLOCK}) AS INT) AS at"), *_COUNTS)
    blocks = rows.groupBy("tile", F.expr(f"CAST(floor(row / {BLOCK}) AS INT) AS bi"), "bj").agg(F.array_sort(F.collect_list(at)).alias("r"))
    last = F.element_at("r", -1)["at"]
    none = F.struct(F.lit(0).alias("at"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    filled = F.transform(F.sequence(F.lit(0), last), lambda k: F.coalesce(F.get(F.filter("r", lambda e: e["at"] == k), F.lit(0)), none))
    whole = blocks.select("tile", "bi", "bj", F.when(F.size("r") == last + 1, F.col("r")).otherwise(filled).alias("r"))
    return whole.select("tile", "bi", "bj", *[F.col(f"r.{c}").alias(c) for c in _COUNTS])


def cover_at(placed: DataFrame, summed: DataFrame, key: str, half: float = 0.0025) -> DataFrame:
    """Shares of trees and grass among the known pixels of the point's tile whose centre lies within ``half`` degrees
    of the point both ways: key, forest_fraction, grassland_fraction (null where nothing is known). ``summed`` is the tiles'
    ``summed_area``, which is never sent to all executors: Spark takes exploded pixels for as small as what they were made of. A point
    meets the blocks that its window touches (four at most, if it is no wider than a block) and counts the bits of the window's rows
    there. The window ends at the tile's rim: what a neighbouring tile holds counts as unknown. To see across seams, give
    ``summed_area`` one tile made of several."""
    first = lambda v: F.greatest(F.lit(0), F.ceil(v).cast("int"))
    last = lambda v, n: F.least(F.col(n).cast("int") - 1, F.floor(v).cast("int"))
    rows, cols = (F.col("y0") - F.col("lat")), (F.col("lon") - F.col("x0"))
    at = placed.select(
        key, "tile", first((rows - half) / F.col("dy") - 0.5).alias("top"), last((rows + half) / F.col("dy") - 0.5, "ny").alias("bottom"),
        first((cols - half) / F.col("dx") - 0.5).alias("before"), last((cols + half) / F.col("dx") - 0.5, "nx").alias("right"),
    )
    some = (F.col("top") <= F.col("bottom")) & (F.col("before") <= F.col("right"))
    blocks = lambda lo, hi: F.explode_outer(F.when(some, F.sequence(F.expr(f"{lo} DIV {BLOCK}").cast("int"), F.expr(f"{hi} DIV {BLOCK}").cast("int"))))
    parts = at.withColumn("bi", blocks("top", "bottom")).withColumn("bj", blocks("before", "right"))
    inner = lambda lo, hi, b: (F.greatest(F.lit(0), F.col(lo) - F.col(b) * BLOCK), F.least(F.lit(BLOCK - 1), F.col(hi) - F.col(b) * BLOCK))
    (r0, r1), (c0, c1) = inner("top", "bottom", "bi"), inner("before", "right", "bj")
    parts = parts.select(key, "tile", "bi", "bj", (r0 + 1).alias("start"), (r1 - r0 + 1).alias("n"), c0.alias("c0"), c1.alias("c1"))
    parts = parts.select(key, "tile", "bi", "bj", "start", "n", F.expr(f"shiftleft(-1L, c0) & shiftrightunsigned(-1L, {BLOCK - 1} - c1)").alias("mask"))
    count = lambda c: F.aggregate(F.slice(c, F.col("start"), F.col("n")), F.lit(0), lambda n, bits: n + F.bit_count(bits.bitwiseAND(F.col("mask"))))
    met = parts.join(summed.hint("merge"), ["tile", "bi", "bj"], "left").select(key, *[count(c).alias(c) for c in _COUNTS])
    met = met.groupBy(key).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return met.select(key, F.try_divide("n_tree", "n_known").alias("forest_fraction"), F.try_divide("n_grass", "n_known").alias("grassland_fraction"))


def sample_points(boxes: DataFrame, key: str, n: int = 5) -> DataFrame:
    """key, sample, lon, lat: n by n points over each box (west, south, east, north), edges included."""
    at = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(k) / (n - 1)
    every = F.sequence(F.lit(0), F.lit(n - 1))
    rows = boxes.withColumn("i", F.explode(every)).withColumn("j", F.explode(every))
    return rows.select(key, (F.col("i") * n + F.col("j")).alias("sample"), at("west", "east", "j").alias("lon"), at("south", "north", "i").alias("lat"))


def forested_tiles(fractions: DataFrame, least: float = 0.15) -> DataFrame:
    """Tiles with any sample above ``least`` of forest."""
    return fractions.groupBy("tile").agg(F.coalesce(F.bool_or(F.col("forest_fraction") > least), F.lit(False)).alias("has_forest"))


def scene_indices(scenes: DataFrame, max_cloud: float = 25) -> DataFrame:
    """NDVI and NBR of the clear pixels of scenes below the cloud limit."""
    clear = F.col("scl").isin(*CLEAR)
    ratio = lambda a, b: F.when(clear, F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b)))
    return scenes.where(F.col("cloud_cover") < max_cloud).select("scene", "tile", "row", "col", ratio("nir", "red").alias("ndvi"), ratio("nir", "swir").alias("nbr"))


def composite(indices: DataFrame) -> DataFrame:
    """Median over the scenes of each pixel: tile, row, col, ndvi, nbr, n_scenes, canopy_alive."""
    made = indices.groupBy("tile", "row", "col").agg(F.median("ndvi").alias("ndvi"), F.median("nbr").alias("nbr"), F.count_distinct("scene").alias("n_scenes"))
    return made.withColumn("canopy_alive", canopy_alive(F.col("ndvi"), F.col("nbr")))


def canopy_alive(ndvi: Column, nbr: Column) -> Column:
    ramp = lambda x, r: m.clamp01((x - r[0]) / (r[1] - r[0]))
    known = ndvi.isNotNull() & nbr.isNotNull() & ~F.isnan(ndvi) & ~F.isnan(nbr)
    return F.when(known, ramp(ndvi, NDVI_RAMP) * ramp(nbr, NBR_RAMP))


def canopy_stats(pixels: DataFrame) -> DataFrame:
    ca = F.col("canopy_alive")
    share = lambda cond: F.avg(F.when(ca.isNotNull(), cond.cast("double")))
    return pixels.agg(F.avg(ca).alias("mean_alive"), share(ca < 0.2).alias("share_cleared"), share(ca > 0.8).alias("share_intact"), F.median("ndvi").alias("median_ndvi"), F.median("nbr").alias("median_nbr"), F.count(ca).alias("n_valid"))


def calibration(pixels: DataFrame) -> DataFrame:
    """cls (cleared, intermediate, intact), share, and mean and population deviation of both indices."""
    ca = F.col("canopy_alive")
    rows = pixels.where(ca.isNotNull()).withColumn("cls", F.when(ca < 0.2, "cleared").when(ca <= 0.8, "intermediate").otherwise("intact"))
    made = rows.groupBy("cls").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in ("ndvi", "nbr") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return made.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def histogram(values: DataFrame, col: str, lo: float = -0.2, hi: float = 0.9, bins: int = 11) -> DataFrame:
    """bin, n: equal bins over lo..hi, the last one closed, empty bins included."""
    v = F.col(col)
    binned = values.where((v >= lo) & (v <= hi)).select(F.least(F.lit(bins - 1), F.floor((v - lo) / ((hi - lo) / bins)).cast("int")).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(binned, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def regrid_nearest(raster: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` (any keys, fy and fx: source row and column as fractions, pixel centres at .5) with the
    value of the pixel that holds the point."""
    keyed = target.withColumns({"row": F.floor("fy").cast("int"), "col": F.floor("fx").cast("int")})
    return keyed.join(raster.select("tile", "row", "col", "value"), ["tile", "row", "col"], "left").drop("row", "col")


def regrid_bilinear(raster: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the weighted mean of the four pixels around the point; missing ones lose their weight.
    To see across the seams of tiles, give it ``with_halo`` of the raster."""
    y, x = F.col("fy") - 0.5, F.col("fx") - 0.5
    near = F.array(*[F.struct((F.floor(y) + i).cast("int").alias("row"), (F.floor(x) + j).cast("int").alias("col"), (F.abs(1 - i - (y - F.floor(y))) * F.abs(1 - j - (x - F.floor(x)))).alias("weight")) for i in (0, 1) for j in (0, 1)])
    sent = target.select("tile", *keys, F.explode(near).alias("p")).select("tile", *keys, "p.*")
    met = sent.join(raster.select("tile", "row", "col", "value"), ["tile", "row", "col"])
    return met.groupBy("tile", *keys).agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")).alias("value"))


def served_cells(spark: SparkSession, box: tuple[float, float, float, float], crs: str, resolution: float) -> tuple[DataFrame, dict]:
    """The cells of a regular grid in Web Mercator metres ("3857") or degrees ("4326") over a box in UTM metres:
    i (from the north), j, and x, y of their centres in UTM; and the grid's west, south, east, north, nx, ny."""
    x0, y0, x1, y1 = box
    edge = spark.range(21).select((F.col("id") / 20.0).alias("t"))  # sides bend in another projection
    sides = [(F.lit(x0) + F.col("t") * (x1 - x0), F.lit(y)) for y in (y0, y1)] + [(F.lit(x), F.lit(y0) + F.col("t") * (y1 - y0)) for x in (x0, x1)]
    corner = F.array(*[F.struct(*[c.alias(n) for n, c in zip(("u", "v"), _to_crs(*projection.utm_inverse(x, y), crs), strict=True)]) for x, y in sides])
    ends = edge.select(F.explode(corner).alias("p")).agg(F.min("p.u").alias("west"), F.min("p.v").alias("south"), F.max("p.u").alias("east"), F.max("p.v").alias("north")).first()
    nx, ny = math.ceil((ends.east - ends.west) / resolution), math.ceil((ends.north - ends.south) / resolution)
    cells = spark.range(nx * ny).select(F.expr(f"CAST(id DIV {nx} AS INT)").alias("i"), (F.col("id") % nx).cast("int").alias("j"))
    u, v = ends.west + (F.col("j") + 0.5) * resolution, ends.north - (F.col("i") + 0.5) * resolution
    lat, lon = projection.mercator_inverse(u, v) if crs == "3857" else (v, u)
    x, y = projection.utm_forward(lat, lon)
    grid = {"west": ends.west, "north": ends.north, "east": ends.west + nx * resolution, "south": ends.north - ny * resolution, "nx": nx, "ny": ny}
    return cells.select("i", "j", x.alias("x"), y.alias("y")), grid


def _to_crs(lat: Column, lon: Column, crs: str) -> tuple[Column, Column]:
    return projection.mercator_forward(lat, lon) if crs == "3857" else (lon, lat)


def served(maps: DataFrame, cells: DataFrame, corner: tuple[float, float], step: float, nearest: bool = True) -> DataFrame:
    """species, i, j, score of every map on served cells: ``maps`` has species, row, col, value, counted from the
    ``corner`` (x, y) in the north-west in steps of ``step``. Nearest keeps values, else the four around are weighed."""
    raster = maps.withColumnRenamed("species", "tile")
    target = cells.select("i", "j", ((corner[1] - F.col("y")) / step).alias("fy"), ((F.col("x") - corner[0]) / step).alias("fx"))
    target = target.crossJoin(F.broadcast(raster.select("tile").distinct()))  # a row a species
    made = regrid_nearest(raster, target) if nearest else regrid_bilinear(raster, target, ["i", "j"])
    return made.where("value IS NOT NULL").select(F.col("tile").alias("species"), "i", "j", F.col("value").alias("score"))


def packed_rows(quantised: DataFrame, nx: int) -> DataFrame:
    """species, i, cells: the row's nx bytes (0 where there is nothing) in base 64, as clients take them."""
    byte = F.lpad(F.hex(F.col("q")), 2, "0")
    rows = quantised.groupBy("species", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", byte.alias("b")))).alias("by_j"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda j: F.coalesce(F.try_element_at("by_j", j), F.lit("00"))), "")
    return rows.select("species", "i", F.base64(F.unhex(line)).alias("cells"))


def quantise(score: Column, score_max: float = SCORE_MAX) -> Column:
    """0 for nodata, else 0..255 with halves to even."""
    return F.when(score <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.rint(score / score_max * 255.0)))).cast("int")


def colour(score: Column, score_max: float = SCORE_MAX) -> tuple[Column, Column]:
    """Normalised value, and an opacity of 200 where the score is above 0.05."""
    return m.clamp01(score / score_max), F.when(score > 0.05, 200).otherwise(0)


def lookup(points: DataFrame, served: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, cutoff: float = 0.30, score_max: float = SCORE_MAX) -> DataFrame:
    """Points (mx, my in Web Mercator metres) with the served score under them; outside, nodata and below the
    cutoff there is none. ``served`` has i, j, q."""
    x0, y0, x1, y1 = box
    at = points.withColumns({"i": F.floor((y1 - F.col("my")) / ((y1 - y0) / ny)).cast("int"), "j": F.floor((F.col("mx") - x0) / ((x1 - x0) / nx)).cast("int")})
    keys = ["i", "j", *(["species"] if "species" in points.columns else [])]
    met = at.join(served.where("q > 0"), keys, "left")
    score = F.col("q") / 255.0 * score_max
    return met.withColumn("score", F.when(score >= cutoff, score)).drop("i", "j", "q")
