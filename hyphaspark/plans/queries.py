"""The registered queries: operators over the adapted tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dynamic_score, grid, projection, static_score
from ..operators import evaluate, layers, observations, publish, rasters, spots, vectors, weather
from ..sources import adapters as a
from ..sources import archive, feeds, folders, layer_tables, polygon_files, suitability
from ..sources import profiles as p
from ..streaming import cell_watch, weather_stream

TODAY = "2024-10-20"
EXTENT = (605000.0, 5060000.0, 693000.0, 5104000.0)  # of the adapted tables, in metres


def _today():
    return F.lit(TODAY).cast("date")


def scored(s: SparkSession, d: str, breakdown: bool = False) -> DataFrame:
    """Scores to nine decimals, so that logarithms of different libraries order cells alike."""
    made = static_score.score_cells(a.with_host(a.cells(s, d)), p.profiles(s), breakdown=breakdown)
    return made.withColumn("score", F.round("score", 9))


def days(s: SparkSession, d: str, key: str = "meteo_cell_id") -> DataFrame:
    made = weather.daily(a.hourly(s, d), key=key)
    return made.withColumns({c: F.round(c, 6) for c in ("precip_mm", "soil_temp_c", "soil_moist")})


def phases(s: SparkSession, d: str) -> DataFrame:
    return weather.phases(days(s, d), p.profiles(s)).withColumn("readiness_raw", F.round("readiness_raw", 9))


def static_suitability(s, d):
    return scored(s, d).select("cell_key", "species", "score")


def static_breakdown(s, d):
    parts = ["host", "habitat_gate", "elevation", "slope", "aspect", "soil_ph", "drainage"]
    return scored(s, d, True).select("cell_key", "species", *[F.round(f"breakdown.{c}", 10).alias(f"m_{c}") for c in parts])


def map_stats(s, d):
    return spots.map_stats(scored(s, d)).withColumn("max_score", F.round("max_score", 6))


def map_topk(s, d):
    return spots.top_cells(scored(s, d), ["cell_key"]).select("species", "rank", "cell_key", "score")


def species_subset(s, d):
    """A map of two species alone, as 32-bit scores."""
    made = static_score.score_cells(a.with_host(a.cells(s, d)), p.profiles(s, only=["boletus_edulis", "cantharellus_cibarius"]))
    return made.groupBy("species").agg(F.count_if(F.round("score", 9).cast("float") > F.lit(0.4).cast("float")).alias("n_above"), F.count("*").alias("n_cells"))


def custom_weights(s, d):
    made = static_score.score_cells(a.with_host(a.cells(s, d)), p.profiles(s), weights={"elevation": 2.0, "slope": 0.0, "aspect": 1.0, "soil_ph": 1.0, "drainage": 0.0})
    return made.groupBy("species").agg(F.round(F.avg("score"), 6).alias("mean_score"))


def meteo_daily(s, d):
    return days(s, d)


def meteo_asof(s, d):
    """The archive as it was at a given hour."""
    made = weather.daily(a.hourly(s, d), F.lit("2024-08-15 12:00:00").cast("timestamp_ntz"))
    return made.groupBy("meteo_cell_id").agg(F.count("*").alias("n_days"), F.max("date").alias("last_date"), F.round(F.sum("precip_mm"), 4).alias("rain"))


_FEATURES = ["month", "cumulative_rain_mm", "soil_temp_c", "soil_moisture", "thermal_shock_c", "days_since_trigger"]


def meteo_features(s, d):
    return weather.features(days(s, d), p.profiles(s)).select("meteo_cell_id", "species", "last_date", *_FEATURES)


def meteo_history(s, d):
    return weather.history(days(s, d))


def readiness(s, d):
    made = dynamic_score.with_readiness(weather.features(days(s, d), p.profiles(s)))
    return made.select("meteo_cell_id", "species", F.round("readiness", 6).alias("readiness"), F.round("charge", 6).alias("charge"))


def readiness_breakdown(s, d):
    made = dynamic_score.with_readiness(weather.features(days(s, d), p.profiles(s)), True)
    return made.select("meteo_cell_id", "species", *[F.round(f"breakdown.{c}", 6).alias(f"m_{c}") for c in ("phenology", "moisture_gate", "rain", "soil_temp", "shock", "lag")])


def phase_by_cell(s, d):
    return spots.phases_by_cell(scored(s, d), phases(s, d)).select("species", "meteo_cell_id", "state", F.round("readiness", 3).alias("readiness"), F.round("charge", 3).alias("charge"), "dst", "eta", "days_past")


def phase_counts(s, d):
    return spots.phases_by_cell(scored(s, d), phases(s, d)).groupBy("species", "state").agg(F.count("*").alias("n"))


def combined_prediction(s, d):
    """Static score times readiness of the cell's weather, summed up by species."""
    rows = scored(s, d).withColumn("meteo_cell_id", grid.weather_cell(F.col("x"), F.col("y")))
    joined = rows.join(phases(s, d).select("species", "meteo_cell_id", "readiness_raw"), ["species", "meteo_cell_id"], "left")
    value = F.col("score") * F.coalesce("readiness_raw", F.lit(0.0))
    return joined.groupBy("species").agg(F.round(F.sum(value), 4).alias("total"), F.round(F.max(value), 6).alias("best"), F.count_if(value > 0).alias("n_positive"))


def candidate_cells(s, d):
    return spots.candidate_cells(scored(s, d))


def candidate_cells_capped(s, d):
    return spots.candidate_cells(scored(s, d), 25)


def _top(mode):
    def run(s, d):
        made = spots.top_spots(scored(s, d), None if mode == "static" else phases(s, d), mode)
        return made.select("species", "rank", *[F.round(c, 3).alias(c) for c in ("score", "suitability", "readiness")], F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))

    return run



def archive_upsert(s, d):
    """An archive of whole days gets a batch that repeats every third day with other values, twice over."""
    old = days(s, d)
    batch = old.where(F.dayofmonth("date") % 3 == 0).select("meteo_cell_id", "date", (F.col("precip_mm") + 1).alias("precip_mm"), "soil_temp_c", "soil_moist")
    both = batch.withColumn("batch", F.lit(1)).unionByName(batch.withColumn("precip_mm", F.col("precip_mm") + 1).withColumn("batch", F.lit(2)))
    return weather.upsert(old, both).withColumn("precip_mm", F.round("precip_mm", 5))


def archive_status(s, d):
    return weather.status(days(s, d))


def archive_gaps(s, d):
    return weather.gaps(spots.candidate_cells(scored(s, d)), days(s, d), _today())


def backfill_todo(s, d):
    return weather.backfill_todo(spots.candidate_cells(scored(s, d)), days(s, d), _today())


def _points(s, d, score="score"):
    return _both_kinds(scored(s, d).select("cell_key", "species", F.col(score).alias("score")))


def _both_kinds(rows):
    """Every cell as background, and some as presences too."""
    present = (F.col("cell_key") * 17) % 101 < (F.col("cell_key") * 31) % 101
    kinds = F.when(present, F.array(F.lit("bg"), F.lit("pres"))).otherwise(F.array(F.lit("bg")))
    return rows.select("species", "score", F.explode(kinds).alias("kind"))


def boyce_by_species(s, d):
    return evaluate.boyce(_points(s, d)).withColumn("boyce", F.round("boyce", 6))


def boyce_curve(s, d):
    return evaluate.boyce_curve(_points(s, d)).select("species", "win", F.round("center", 6).alias("center"), F.round("pe", 6).alias("pe"))


def boyce_delta(s, d):
    """Against a model that leaves soil and aspect out."""
    made = static_score.score_cells(a.with_host(a.cells(s, d)), p.profiles(s), weights=static_score.WEIGHTS | {"soil_ph": 0.0, "aspect": 0.0})
    reduced = _both_kinds(made.select("cell_key", "species", F.round("score", 9).alias("score")))
    made = evaluate.compare(evaluate.boyce(reduced), evaluate.boyce(_points(s, d)))
    return made.select("species", *[F.round(c, 6).alias(c) for c in ("baseline", "variant", "delta")])


def terrain_stencil(s, d):
    return rasters.terrain(a.pixels(s, d), F.lit(30.0), F.lit(30.0), 8)


def _layout(s, d):
    """Where the tiles lie in the raster that they make up: columns go east and rows south."""
    return a.tiles(s, d).selectExpr("tile", "tile % 50 AS tx", "-(tile DIV 50) AS ty", "nx", "ny")


def terrain_seamless(s, d):
    """Terrain over all tiles as one raster."""
    return rasters.terrain_seamless(a.pixels(s, d), _layout(s, d), F.lit(30.0), F.lit(30.0), 8)


def soil_ph_sample(s, d):
    ph, cls = rasters.soil_ph(F.col("ph10"))
    return a.pixels(s, d).select("tile", "row", "col", ph.alias("soil_ph_value"), cls.alias("soil_ph"))


def _pixel_points(s, d):
    return rasters.on_tiles(a.geo_points(s, d), a.tiles(s, d), "cell_key")


def tile_lookup(s, d):
    return _pixel_points(s, d).select("cell_key", "tile", "row", "col")


def terrain_at(s, d):
    return rasters.terrain_at(_pixel_points(s, d), a.pixels(s, d), "cell_key")


def landcover_at(s, d):
    return _shares(rasters.cover_at(_pixel_points(s, d), rasters.summed_area(a.pixels(s, d)), "cell_key", 0.004))


def landcover_window(s, d):
    """Land cover in the full window of 0.0025 degrees both ways, over fine pixels."""
    points = rasters.on_tiles(a.geo_points(s, d), a.fine_tiles(s, d), "cell_key")
    return _shares(rasters.cover_at(points, rasters.summed_area(a.fine_pixels(s, d)), "cell_key"))


def _shares(made):
    return made.select("cell_key", F.round("forest_fraction", 6).alias("forest_fraction"), F.round("grassland_fraction", 6).alias("grassland_fraction"))


def forest_regions(s, d):
    """Regions of 0.02 by 0.04 degrees with any of 5 x 5 samples in forest, less those whose canopy is there."""
    boxes = a.tiles(s, d).selectExpr("tile AS region", "x0 AS west", "y0 - 0.02D AS south", "x0 + 0.02D AS east", "y0 + 0.02D AS north")
    spots = rasters.sample_points(boxes, "region").select(F.struct("region", "sample").alias("spot"), "lon", "lat")
    shares = rasters.cover_at(rasters.on_tiles(spots, a.tiles(s, d), "spot"), rasters.summed_area(a.pixels(s, d)), "spot").select(F.col("spot.region").alias("tile"), "forest_fraction")
    made = rasters.forested_tiles(shares).where("has_forest").select(F.col("tile").alias("region"))
    return made.join(a.tiles(s, d).where("tile % 8 = 0").select(F.col("tile").alias("region")), "region", "left_anti")


def canopy_sample(s, d):
    """Canopy under the cells: an equi-join on tile, row and column; outside all tiles there is none."""
    points = a.cells(s, d).select("cell_key").join(tile_lookup(s, d), "cell_key", "left")
    made = rasters.sample(points, a.pixels(s, d).withColumn("canopy", F.col("value") / 2000.0), "canopy")
    return made.select("cell_key", F.round(rasters.canopy(F.col("canopy")), 6).alias("canopy_alive"))


def landcover_fraction(s, d):
    return rasters.cover_fractions(a.pixels(s, d), 2).select("tile", "row", "col", F.round("forest_fraction", 6).alias("forest_fraction"), F.round("grassland_fraction", 6).alias("grassland_fraction"))


def tiles_with_forest(s, d):
    """Forested tiles that are not there yet."""
    made = rasters.forested_tiles(rasters.cover_fractions(a.pixels(s, d), 1)).where("has_forest")
    landed = a.pixels(s, d).where("tile % 4 = 0").select("tile").distinct()
    return made.select("tile").join(landed, "tile", "left_anti")


def scene_indices(s, d):
    return rasters.scene_indices(a.scenes(s, d)).select("scene", "tile", "row", "col", F.round("ndvi", 6).alias("ndvi"), F.round("nbr", 6).alias("nbr"))


def _composite(s, d):
    return rasters.composite(rasters.scene_indices(a.scenes(s, d))).withColumns({c: F.round(c, 6) for c in ("ndvi", "nbr", "canopy_alive")})


def scene_median(s, d):
    return _composite(s, d)


def canopy_stats(s, d):
    return rasters.canopy_stats(_composite(s, d)).select(*[F.round(c, 9).alias(c) for c in ("mean_alive", "share_cleared", "share_intact", "median_ndvi", "median_nbr")], "n_valid")


def canopy_calibration(s, d):
    """Over the pixels whose centre lies in a conifer forest."""
    at = {"x": "605000.0D + ((tile % 200) * 8 + col + 0.5D) * 55.0D", "y": "5066000.0D - (tile DIV 200 * 8 + row + 0.5D) * 55.0D"}
    pixels = _composite(s, d).withColumns({k: F.expr(v) for k, v in at.items()})
    made = rasters.calibration(vectors.masked(pixels, a.conifers(s, d), ["tile", "row", "col"]))
    return made.select("cls", "n", *[F.round(c, 9).alias(c) for c in ("share", "mean_ndvi", "std_ndvi", "mean_nbr", "std_nbr")])


def canopy_histogram(s, d):
    return rasters.histogram(_composite(s, d), "nbr")


def geology_class(s, d):
    made = vectors.containing(a.cells(s, d), a.polygons(s, d), "cell_key")
    return made.select("cell_key", "poly_id", vectors.lithology_class(F.col("attr"), F.col("region")).alias("soil_ph"))


def geology_nearest(s, d):
    cells, polys = a.cells(s, d), a.polygons(s, d)
    rest = cells.join(vectors.containing(cells, polys, "cell_key"), "cell_key", "left_anti")
    return vectors.nearest(rest, polys, "cell_key").select("cell_key", "poly_id", F.round("dist", 3).alias("dist"))


def geology_merged(s, d):
    return vectors.geology(a.cells(s, d), a.polygons(s, d), "cell_key")


def forest_host(s, d):
    codes = F.array(*[F.lit(c) for c in p.CATEGORY_CODES], F.lit("ZZ"))
    polys = a.polygons(s, d).withColumn("attr", F.concat(F.lit(" "), F.get(codes, (F.col("poly_id") % 21).cast("int"))))
    made = vectors.forest_host(a.cells(s, d), polys, p.crosswalk(s), "cell_key")
    return made.select("cell_key", "forest_category", F.get(F.map_keys("host"), F.lit(0)).alias("host_class"))


class _Layer:
    def __init__(self, name, rows):
        self.name, self.rows = name, rows

    def attach(self, cells):
        return self.rows


def layer_merge(s, d):
    """Cells with terrain (required), geology (skipping null) and soil layers, the later winning. Pixels are never sent to all executors."""
    points = tile_lookup(s, d)
    base = points.join(terrain_stencil(s, d).hint("merge"), ["tile", "row", "col"]).select("cell_key", "elevation_m", "slope_deg", "aspect")
    soil = points.join(soil_ph_sample(s, d).hint("merge"), ["tile", "row", "col"]).select("cell_key", "soil_ph")
    geo = vectors.geology(a.cells(s, d), a.polygons(s, d), "cell_key").select("cell_key", "soil_ph", "geology_fallback")
    made, _ = layers.compose(a.cells(s, d).select("cell_key"), [_Layer("dem", base), _Layer("geology", geo), _Layer("none", None), _Layer("soil", soil)], "cell_key", base="dem")
    return made.select("cell_key", "elevation_m", "slope_deg", "aspect", "soil_ph", "geology_fallback")


def suitability_at(s, d):
    """Scores from merged layers; cells without a record have none."""
    made = static_score.score_cells(layer_merge(s, d), p.profiles(s))
    return made.select("cell_key", "species", F.round("score", 6).alias("score"))


def cell_ids(s, d):
    return a.cells(s, d).select("cell_key", grid.static_cell(F.col("x"), F.col("y")).alias("static_cell_id"), grid.weather_cell(F.col("x"), F.col("y")).alias("meteo_cell_id"))


def cell_centers(s, d):
    cells = cell_ids(s, d).select("meteo_cell_id").distinct()
    lat, lon = grid.center(F.col("meteo_cell_id"))
    return cells.select("meteo_cell_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def cell_polygons(s, d):
    made = cell_ids(s, d).select("meteo_cell_id").distinct().select("meteo_cell_id", grid.polygon(F.col("meteo_cell_id")).alias("ring"))
    return made.select("meteo_cell_id", *[F.col("ring")[k][c].alias(f"{n}{k}") for k in range(4) for c, n in ((0, "lon"), (1, "lat"))])


def projected_round_trip(s, d):
    """Cells to degrees, and back to their keys."""
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    rows = a.cells(s, d).select("cell_key", "x", "y", lat.alias("lat"), lon.alias("lon"))
    x, y = projection.utm_forward(F.col("lat"), F.col("lon"))
    near = (F.abs(x - F.col("x")) < 1e-3) & (F.abs(y - F.col("y")) < 1e-3)
    return rows.select("cell_key", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), near.alias("returns"))


def homolosine(s, d):
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    x, y = projection.homolosine_forward(lat, lon)
    return a.cells(s, d).select("cell_key", F.round(x, 2).alias("hx"), F.round(y, 2).alias("hy"))


def _map(s, d):
    """Maps on a coarse grid of 2200 m: species, i, j, score (the best cell)."""
    return scored(s, d).groupBy("species", F.floor((EXTENT[3] - F.col("y")) / 2200.0).cast("int").alias("i"), F.floor((F.col("x") - EXTENT[0]) / 2200.0).cast("int").alias("j")).agg(F.max("score").alias("score"))


def quantised_grid(s, d):
    return _map(s, d).select("species", "i", "j", rasters.quantise(F.col("score")).alias("q"))


def colour_grid(s, d):
    value, alpha = rasters.colour(F.col("score"))
    return _map(s, d).select("species", "i", "j", F.round(value, 6).alias("norm"), alpha.alias("alpha"))


def point_lookup(s, d):
    """The served score under each cell's centre, for every species."""
    served, grid = _served(s, d)
    x, y = projection.mercator_forward(*projection.utm_inverse(F.col("x"), F.col("y")))
    points = a.cells(s, d).select("cell_key", x.alias("mx"), y.alias("my")).crossJoin(F.broadcast(p.profiles(s).select("species")))
    made = rasters.lookup(points, served, (grid["west"], grid["south"], grid["east"], grid["north"]), grid["nx"], grid["ny"])
    return made.select("cell_key", "species", F.round("score", 6).alias("score"))


def _projected(s, d, crs, resolution, nearest):
    cells, grid = rasters.served_cells(s, EXTENT, crs, resolution)
    maps = _map(s, d).select("species", F.col("i").alias("row"), F.col("j").alias("col"), F.col("score").alias("value"))
    return rasters.served(maps, cells, (EXTENT[0], EXTENT[3]), 2200.0, nearest), grid


def _served(s, d):
    """The maps in Web Mercator, quantised, and their grid."""
    made, grid = _projected(s, d, "3857", 3000.0, True)
    return made.select("species", "i", "j", rasters.quantise(F.col("score")).alias("q")), grid


def served_rows(s, d):
    served, grid = _served(s, d)
    bounds = {side: F.round(F.lit(grid[side]), 3) for side in ("west", "south", "east", "north")}
    return rasters.packed_rows(served, grid["nx"]).withColumns({"nx": F.lit(grid["nx"]), "ny": F.lit(grid["ny"])} | bounds)


def overlay_bounds(s, d):
    """Each map's overlay in degrees: how many of its cells are visible, and its box, size and largest value."""
    made, grid = _projected(s, d, "4326", 0.02, False)
    value, alpha = rasters.colour(F.round("score", 9))
    found = made.groupBy("species").agg(F.count_if(alpha > 0).alias("n_visible"), F.round(F.max(value), 6).alias("largest"))
    return found.withColumns({side: F.round(F.lit(grid[side]), 6) for side in ("west", "south", "east", "north")} | {n: F.lit(grid[n]) for n in ("nx", "ny")})


def overlay_grid(s, d):
    """The maps in degrees, smoothed, as colour values and opacity."""
    made, _ = _projected(s, d, "4326", 0.02, False)
    value, alpha = rasters.colour(F.round("score", 9))
    return made.select("species", "i", "j", F.round(value, 6).alias("norm"), alpha.alias("alpha"))


def suitability_table(s, d):
    """Maps of all species, two of them then replaced by those of other weights, read back by species."""
    path = folders.fresh(s, "suitability")
    suitability.write(scored(s, d).select("species", "cell_key", "x", "y", "score"), path)
    again = static_score.score_cells(a.with_host(a.cells(s, d)), p.profiles(s, only=["boletus_edulis", "cantharellus_cibarius"]), weights={"elevation": 2.0, "slope": 0.0, "aspect": 1.0, "soil_ph": 1.0, "drainage": 0.0})
    suitability.write(again.select("species", "cell_key", "x", "y", F.round("score", 9).alias("score")), path)
    made = suitability.read(s, path).groupBy("species").agg(F.count("*").alias("n_cells"), F.count_if(spots.above()).alias("n_above"), F.round(F.avg(F.col("score").cast("double")), 5).alias("mean_score"))
    return made.withColumn("species", F.col("species").cast("string"))


def species_list(s, d):
    """The species that there are maps for."""
    path = folders.fresh(s, "suitability")
    suitability.write(scored(s, d).where(spots.above()).select("species", "cell_key", "x", "y", "score"), path)
    return suitability.species(s, path)


def species_menu(s, d):
    """The species that have candidate cells, in the order of their common names."""
    have = scored(s, d).where(spots.above()).groupBy("species").agg(F.count("*").alias("n_candidates"))
    made = p.profiles(s).join(have, "species").select("species", "common_name", "n_candidates")
    return made.withColumn("place", F.row_number().over(Window.orderBy("common_name", "species")))  # a row a species


def _box(s, d):
    """The cells' box in degrees."""
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    return a.cells(s, d).agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max")).first().asDict()


def grid_cells(s, d):
    """The static grid over the cells' box in steps of 1 km, with the number of cells in each square."""
    made = grid.static_grid(s, _box(s, d), 1000.0)
    held = a.cells(s, d).groupBy(F.floor(F.col("x") / 1000.0).alias("col"), F.floor(F.col("y") / 1000.0).alias("row")).agg(F.count("*").alias("n_cells"))
    return made.join(held, ["col", "row"], "left").select("col", "row", "x", "y", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def map_cells(s, d):
    """The map grid over the cells' box in steps of 2 km, with the best score of each species."""
    box = _box(s, d)
    made = grid.map_grid(s, box, 2000.0)
    first = made.where("i = 0 AND j = 0").first()
    at = {"i": F.floor((F.lit(first.y + 1000.0) - F.col("y")) / 2000.0).cast("int"), "j": F.floor((F.col("x") - F.lit(first.x - 1000.0)) / 2000.0).cast("int")}
    best = scored(s, d).withColumns(at).groupBy("i", "j", "species").agg(F.max("score").alias("score"))
    return made.join(best, ["i", "j"], "left").select("i", "j", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "species", F.round("score", 6).alias("score"))


def grid_dimensions(s, d):
    """Columns, rows and cells of the static grid over the cells' box, from two of its corners."""
    return grid.dimensions(s, _box(s, d), 100.0)


def named_places(s, d):
    """Cells with the name that was landed for their coordinates: for every third cell, and some more at the same places."""
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    points = a.cells(s, d).select("cell_key", lat.alias("lat"), lon.alias("lon"))
    name = F.concat(F.lit("place "), F.col("cell_key").cast("string"))
    landed = points.where("cell_key % 3 = 0").select("lat", "lon", name.alias("name")).unionByName(points.where("cell_key % 6 = 0").select("lat", "lon", F.concat(F.lit("a "), name).alias("name")))
    return vectors.lookup_by_coordinates(points, landed).select("cell_key", "name")


def scene_selection(s, d):
    """The composite of the scenes of a month that touch the area and are clear enough."""
    catalogue = a.scenes(s, d).groupBy(F.col("scene").alias("scene_id")).agg(F.max("cloud_cover").cast("double").alias("cloud_cover"), F.count("*").alias("n"))
    west = 10.0 + (F.col("scene_id") % 4) * 1.2
    catalogue = catalogue.withColumns({"scene_date": F.date_format(F.date_add(F.lit("2024-07-01").cast("date"), F.col("scene_id") * 9), "yyyy-MM-dd"), "lon_min": west, "lon_max": west + 1.0, "lat_min": F.lit(45.0), "lat_max": F.lit(46.0)})
    chosen = feeds.scenes(catalogue, "2024-07-05", "2024-08-31", grid.AREA)
    rows = a.scenes(s, d).join(chosen.select(F.col("scene_id").alias("scene")), "scene", "left_semi")
    return rasters.composite(rasters.scene_indices(rows)).withColumns({c: F.round(c, 6) for c in ("ndvi", "nbr", "canopy_alive")})


def random_validation(s, d):
    """The index of each species from the clean observations that have coordinates, against random points of the area, as many
    as cells."""
    seen = observations.clean(a.observations(s, d)).where("error IS NULL AND x IS NOT NULL AND species IS NOT NULL").select("species", "x", "y")
    x, y = projection.utm_forward(F.col("lat"), F.col("lon"))
    ground = feeds.background(s, a.cells(s, d).count(), {"lat_min": 45.65, "lat_max": 46.1, "lon_min": 10.35, "lon_max": 11.5}, 7).select(x.alias("x"), y.alias("y"))
    return evaluate.validate(seen, ground, _map(s, d), (EXTENT[0], EXTENT[3]), 2200.0).withColumn("boyce", F.round("boyce", 6))


def geojson_pins(s, d):
    return publish.pin_features(observations.pins(observations.clean(a.observations(s, d)).where("error IS NULL")))


def tile_manifest(s, d):
    """The elevation tiles of one degree that the cells need, less those that are there."""
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    box = a.cells(s, d).agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max")).first().asDict()
    need = feeds.tile_manifest(s, box, 1, "%s%02d_%s%03d")
    return need.join(need.where("(lat + lon) % 2 = 0").select("tile"), "tile", "left_anti").select("tile", "lat", "lon")


def soil_extent(s, d):
    """The cells' box in the soil raster's projection."""
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    box = a.cells(s, d).agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max")).first().asDict()
    return feeds.projected_box(s, box).select(*[F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")])


def occurrence_ingest(s, d):
    """Result pages of an occurrence feed, made of the events, read back: at most 1000 a species, inside the area."""
    names = F.array(*[F.lit(n) for n in sorted(x["id"] for x in p.PROFILES)])
    rows = a.table(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 13 <> 0 THEN 44.5D + (event_id * 7919 % 3000) / 1000.0D END AS decimalLatitude", "10.0D + (event_id * 104729 % 4000) / 1000.0D AS decimalLongitude", "year(ts) AS year", "event_id AS key")
    rows = rows.withColumn("species", F.get(names, (F.col("event_id") % 6).cast("int"))).withColumn("page", F.expr("event_id DIV 300"))
    result = F.struct("key", "decimalLatitude", "decimalLongitude", "year")
    pages = rows.groupBy("species", "page").agg(F.array_sort(F.collect_list(result)).alias("results")).select("species", "page", F.to_json(F.struct("results")).alias("value"))
    return feeds.occurrences(pages, grid.AREA)


def geojson_occurrences(s, d):
    made = occurrence_ingest(s, d)
    return made.select("gbif_key", feeds.as_feature(["species", "year"]).alias("geojson"))


def _polygon_pages(s, d):
    """The polygons as landed pages: some without geometry, some without a name, every fifth in several parts."""
    points = lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))
    single = F.to_json(F.transform("rings", points))
    several = F.to_json(F.transform("rings", lambda r: F.array(points(r))))
    shape = F.when(F.col("poly_id") % 11 == 0, F.lit("null")).when(F.col("poly_id") % 5 == 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), several, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), single, F.lit("}")))
    name = F.when(F.col("poly_id") % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "attr"))
    feature = F.concat(F.lit('{"id":'), F.col("poly_id").cast("string"), F.lit(',"geometry":'), shape, F.lit(',"properties":'), F.to_json(F.struct(name.alias("NAME"))), F.lit("}"))
    pages = a.polygons(s, d).groupBy(F.expr("poly_id DIV 25").alias("page")).agg(F.array_join(F.collect_list(feature), ",").alias("fs"))
    return pages.select("page", F.concat(F.lit('{"features":['), "fs", F.lit("]}")).alias("value"))


def polygon_ingest(s, d):
    made, _ = feeds.polygon_pages(_polygon_pages(s, d), "NAME")
    return made.select("poly_id", "attr", F.size("rings").alias("n_rings"), F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)).alias("n_points"))


def polygon_ingest_counters(s, d):
    _, counters = feeds.polygon_pages(_polygon_pages(s, d), "NAME")
    return counters


def _broken_pages(s, d):
    """The polygons as landed pages of shapes in four forms: a ring that crosses itself, two parts that overlap, a part
    within a part, and a sound one with a hole."""
    rows = a.polygons(s, d).select("poly_id", "attr", "region", F.col("rings")[0].alias("r"))
    rows = rows.select("poly_id", "attr", "region", F.col("r")[1]["x"].alias("x"), F.col("r")[0]["y"].alias("y"), (F.col("r")[0]["x"] - F.col("r")[1]["x"]).alias("a"))
    point = lambda dx, dy: F.array(F.col("x") + dx * F.col("a"), F.col("y") + dy * F.col("a"))
    rhomb = lambda dx, k: F.array(*[point(dx + u * k, v * k) for u, v in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))])
    bow = F.array(*[point(u, v) for u, v in ((-1, -1), (0.5, 0.5), (0.5, -0.5), (-1, 1), (-1, -1))])
    form = F.col("poly_id") % 4
    parts = F.when(form == 0, F.array(F.array(bow))).when(form == 1, F.array(F.array(rhomb(0, 1)), F.array(rhomb(1, 1)))).when(form == 2, F.array(F.array(rhomb(0, 1)), F.array(rhomb(0, 0.5)))).otherwise(F.array(F.array(rhomb(0, 1), rhomb(0, 0.5))))
    feature = F.concat(F.lit('{"id":'), F.col("poly_id").cast("string"), F.lit(',"geometry":{"type":"MultiPolygon","coordinates":'), F.to_json(parts), F.lit('},"properties":'), F.to_json(F.struct(F.col("attr").alias("NAME"))), F.lit("}"))
    return rows.groupBy(F.expr("poly_id DIV 25").alias("page")).agg(F.array_join(F.collect_list(feature), ",").alias("fs")).select("page", F.concat(F.lit('{"features":['), "fs", F.lit("]}")).alias("value"))


def polygon_repair(s, d):
    """Cells in the repaired shapes."""
    made, _ = feeds.polygon_pages(_broken_pages(s, d), "NAME")
    return vectors.containing(a.cells(s, d), made.withColumn("region", F.lit("tn")), "cell_key").select("cell_key", "poly_id", "attr")


def polygon_repair_counters(s, d):
    _, counters = feeds.polygon_pages(_broken_pages(s, d), "NAME")
    return counters


PARTS = 3  # of the hours, which land and are streamed one after the other


def _streamed(s, d, watched=None) -> str:
    """The folder of an archive that a stream of the hours keeps. They land in parts, by the time that they arrive: up to 40 hours
    late, and every fiftieth once more with the next part. Each part is a run of its own, which goes on from the checkpoint. With
    ``watched`` (profiles, cells) a second stream follows the changes."""
    path = folders.fresh(s, "stream")
    rows = a.hourly(s, d).select("event_id", "meteo_cell_id", "time", "precip", "soil_temp", "soil_moist").withColumn("arrives", F.expr("time + make_dt_interval(0, CAST(event_id % 3 * 20 AS INT))"))
    ends = rows.agg(F.min("arrives").alias("a"), F.max("arrives").alias("b")).first()
    for k in range(PARTS):
        since, until = (ends.a + (ends.b - ends.a) * (k + e) / PARTS for e in (0, 1))
        after = lambda t: F.col("arrives") > F.lit(t)
        new = (after(since) | F.lit(k == 0)) & (~after(until) | F.lit(k == PARTS - 1))
        again = ~after(since) & after(since - (ends.b - ends.a) / PARTS) & (F.col("event_id") % 50 == 0) & F.lit(k > 0)
        rows.where(new).drop("arrives").unionByName(rows.where(again).drop("arrives")).write.parquet(f"{path}/in/part{k}")
        hours = s.readStream.schema(weather_stream.SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        weather_stream.run_archive(hours, f"{path}/archive", f"{path}/checkpoint", digits=6).awaitTermination()
        if watched:
            weather_stream.run_watch(s, f"{path}/archive", f"{path}/events", f"{path}/watch", *watched).awaitTermination()
    return path


def stream_daily(s, d):
    """The archive that a stream of the hours keeps."""
    return archive.read(s, f"{_streamed(s, d)}/archive", weather_stream.ARCHIVE).select("meteo_cell_id", "date", "precip_mm", "soil_temp_c", "soil_moist")


def stream_phases(s, d):
    """The phases from the state of cells that follows the stream."""
    made = weather_stream.phases(s.read.parquet(f"{_streamed(s, d, (p.profiles(s),))}/events"), p.profiles(s)).where("state IS NOT NULL").withColumn("readiness", F.round("readiness_raw", 9))
    return made.select("species", "meteo_cell_id", "state", F.round("readiness", 3).alias("readiness"), F.round("charge", 3).alias("charge"), "dst", "eta", "days_past")


def stream_features(s, d):
    """Rolling features from the state of cells that follows the stream."""
    events = s.read.parquet(f"{_streamed(s, d, (p.profiles(s),))}/events")
    return cell_watch.features(cell_watch.latest(events, ["features"]), p.profiles(s)).select("meteo_cell_id", "species", "last_date", *_FEATURES)


def stream_gaps(s, d):
    """The watched cells that are behind when the stream ends, from the alerts of timers."""
    watched = folders.staged(spots.candidate_cells(scored(s, d)))  # each batch of the stream reads them
    return cell_watch.stale(s.read.parquet(f"{_streamed(s, d, (p.profiles(s), watched))}/events")).join(watched, "meteo_cell_id", "left_semi")


def stream_observations(s, d):
    """Field records captured by a stream: clean ones with their cells, the others from quarantine."""
    path, raw = folders.fresh(s, "capture"), a.observations(s, d)
    raw.write.parquet(f"{path}/in")
    rows = s.readStream.schema(raw.schema).parquet(f"{path}/in")
    weather_stream.capture_observations(rows, f"{path}/clean", f"{path}/quarantine", f"{path}/checkpoint").awaitTermination()
    kept = "id LONG, species STRING, phase STRING, static_cell_id STRING, meteo_cell_id STRING, error STRING"
    both = [s.read.schema(kept).parquet(f"{path}/{part}").withColumn("sink", F.lit(part)) for part in ("clean", "quarantine")]
    return both[0].unionByName(both[1]).drop("batch")


def _responses(s, d):
    """(requests, documents) of an hourly feed, made of the events: ten stations a batch, in the order of the request.
    Every seventh batch asked for one place more than came back."""
    hours = a.hourly(s, d).withColumn("batch", F.expr("station DIV 10"))
    row = F.struct("time", "event_id", "precip", "soil_temp", "soil_moist")
    one = hours.groupBy("batch", "station", "meteo_cell_id").agg(F.array_sort(F.collect_list(row)).alias("h"))
    of = lambda name, to, f=lambda v: v: F.transform("h", lambda r: f(r[name])).alias(to)
    series = F.struct(of("time", "time", lambda v: F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), of("precip", "precipitation"), of("soil_temp", "soil_temperature_6cm"), of("soil_moist", "soil_moisture_3_to_9cm"))
    asked = one.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("station", "meteo_cell_id"))).alias("c"))
    more = F.when(F.col("batch") % 7 == 0, F.array(F.lit("unanswered"))).otherwise(F.array().cast("array<string>"))
    requests = asked.select("batch", F.posexplode(F.concat(F.transform("c", lambda r: r["meteo_cell_id"]), more)).alias("location", "meteo_cell_id"))
    docs = one.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("station", F.to_json(F.struct(series.alias("hourly"))).alias("j")))).alias("c"))
    return requests, docs.select("batch", F.concat(F.lit("["), F.array_join(F.transform("c", lambda r: r["j"]), ","), F.lit("]")).alias("value"))


def hourly_feed(s, d):
    """Days from the landed responses of the hourly feed, whose series get their cells by position."""
    requests, docs = _responses(s, d)
    made = weather.daily(feeds.match_requests(requests, feeds.hourly(docs), ["batch"]))
    return made.select("meteo_cell_id", "date", *[F.round(c, 6).alias(c) for c in ("precip_mm", "soil_temp_c", "soil_moist")])


def feed_mismatches(s, d):
    requests, docs = _responses(s, d)
    return feeds.mismatches(requests, feeds.hourly(docs), ["batch"])


def ingest_windows(s, d):
    """Id windows of the polygon pages that did not land (every fourth page), and how many rows they may hold."""
    pages = _polygon_pages(s, d)
    last = feeds.max_object_id(pages).first().max_id
    landed = pages.where("page % 4 <> 3").select((F.col("page") * 25).alias("lo"))
    return feeds.missing_windows(s, landed, last, 25).select("lo", "hi", (F.least("hi", F.lit(last)) - F.col("lo") + 1).alias("at_most"))


def polygon_table(s, d):
    """Two polygon layers in one table, the first written twice, read back."""
    path = folders.fresh(s, "polygons")
    made, _ = feeds.polygon_pages(_polygon_pages(s, d), "NAME")
    for rows, layer in ((made.withColumn("attr", F.lit("old")), "geology"), (made.where("size(rings) > 1"), "forest"), (made, "geology")):
        layer_tables.write(rows, path, layer)
    both = [layer_tables.read(s, path, layer).withColumn("layer", F.lit(layer)) for layer in ("geology", "forest")]
    return both[0].unionByName(both[1]).select("layer", "poly_id", "attr", F.size("rings").alias("n_rings"))


def canopy_table(s, d):
    """The canopy layer written in two runs, of which the second finds half of the tiles there."""
    path, made = folders.fresh(s, "canopy"), _composite(s, d).select("tile", "row", "col", "canopy_alive")
    layer_tables.append_tiles(made.where("tile % 2 = 0"), path, "canopy")
    layer_tables.append_tiles(made, path, "canopy")
    return layer_tables.read(s, path, "canopy").select("tile", "row", "col", "canopy_alive")


def species_validation(s, d):
    """The index of each species from the clean observations that have coordinates, against all cells."""
    seen = observations.clean(a.observations(s, d)).where("error IS NULL AND x IS NOT NULL AND species IS NOT NULL").select("species", "x", "y")
    made = evaluate.validate(seen, a.cells(s, d).select("x", "y"), _map(s, d), (EXTENT[0], EXTENT[3]), 2200.0)
    return made.withColumn("boyce", F.round("boyce", 6))


def profile_quality(s, d):
    """Submitted profiles, made of the parts, with what is wrong with each document and each submission."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    host = pick(p.HOST_CLASSES, size % 20)
    names = F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 7 == 0, F.array(host, F.lit("abetaia"), F.concat(F.lit("bosco_"), size.cast("string")))).otherwise(F.array(host))
    rows = a.table(s, d, "part").select(
        F.concat(F.lit("part_"), key.cast("string"), F.when(key % 17 == 0, ".yml").otherwise(".yaml")).alias("file"),
        F.when(key % 19 == 0, F.lit("other")).otherwise(F.concat(F.lit("part_"), key.cast("string"))).alias("species"),
        pick([*p.TROPHIC_MODES, "parasitic"], size % 4).alias("trophic_mode"), pick([*p.HABITATS, "sea"], key % 3).alias("habitat"),
        F.map_from_arrays(names, F.transform(names, lambda n: F.lit(1.0))).alias("host_genera"), F.array((size % 14).cast("int"), F.lit(6)).alias("phenology_months"),
        F.when(key % 23 == 0, "not a document").alias("parse_error"),
    )
    return rows.select("file", F.array_join(p.errors(), "; ").alias("errors"), F.array_join(p.submission_errors(), "; ").alias("refused"), p.scientific_name(F.col("species")).alias("name"))


def _targets(s, d):
    tiles = F.broadcast(a.tiles(s, d).agg((F.max("tile") + 1).alias("n")))  # one row
    return a.cells(s, d).crossJoin(tiles).select((F.col("cell_key") % F.col("n")).alias("tile"), "cell_key", (F.col("cell_key") * 7919 % 800 / 100.0).alias("fy"), (F.col("cell_key") * 104729 % 800 / 100.0).alias("fx"))


def regrid_nearest(s, d):
    return rasters.regrid_nearest(a.pixels(s, d), _targets(s, d)).select("cell_key", F.round("value", 6).alias("value"))


def regrid_bilinear(s, d):
    return rasters.regrid_bilinear(a.pixels(s, d), _targets(s, d), ["cell_key"]).select("cell_key", F.round("value", 5).alias("value"))


def regrid_seamless(s, d):
    """Bilinear values that see the neighbouring tiles."""
    raster = rasters.with_halo(a.pixels(s, d).select("tile", "row", "col", "value"), _layout(s, d))
    return rasters.regrid_bilinear(raster, _targets(s, d), ["cell_key"]).select("cell_key", F.round("value", 5).alias("value"))


def raster_scan(s, d):
    """Elevation, land cover and soil pH in a box, from a stored layer of which only the zones of the box are read."""
    path = folders.fresh(s, "rasters")
    layer_tables.write_raster(a.pixels(s, d), a.tiles(s, d), path, "ground", 0.02)
    made = layer_tables.scan_raster(s, path, "ground", (10.25, 46.05, 10.6, 46.15), 0.02)
    ph, cls = rasters.soil_ph(F.col("ph10"))
    return made.select("tile", "row", "col", F.round("value", 6).alias("elevation_m"), "landcover", ph.alias("soil_ph_value"), cls.alias("soil_ph"))


def forest_layers(s, d):
    """Forest categories of cells from files of three regions, with columns of their own and two projections."""
    codes = F.array(*[F.lit(c) for c in p.CATEGORY_CODES], F.lit("ZZ"))
    rows = a.polygons(s, d).withColumn("code", F.concat(F.lit(" "), F.get(codes, (F.col("poly_id") % 21).cast("int"))))
    path = folders.fresh(s, "forest")
    pairs = lambda rings: F.to_json(F.transform(rings, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    for k, (field, metres) in enumerate((("CATEGORIA", True), ("tipo_fores", False), ("Ct_CFI", False))):
        first = F.slice("rings", 1, F.when(F.col("poly_id") % 3 == 0, 2).otherwise(1))  # the shell and its hole
        crs = '"crs":{"type":"name","properties":{"name":"EPSG:32632"}},' if metres else ""
        properties = F.to_json(F.struct(F.col("code").alias(field), F.col("region").alias(f"extra_{k}")))
        line = F.concat(F.lit('{"type":"Feature",' + crs + '"id":'), F.col("poly_id").cast("string"), F.lit(',"geometry":{"type":"Polygon","coordinates":'), pairs(first if metres else polygon_files.to_degrees(first)), F.lit('},"properties":'), properties, F.lit("}"))
        rows.where(F.col("poly_id") % 3 == k).select(line.alias("value")).write.text(f"{path}/{k}")
    made, _ = polygon_files.read(s, path, ["CATEGORIA", "tipo_fores", "Ct_CFI"])
    by_id = made.withColumn("poly_id", F.col("poly_id") % (1 << 40)).withColumn("region", F.lit(""))
    found = vectors.forest_host(a.cells(s, d), by_id, p.crosswalk(s), "cell_key")
    return found.select("cell_key", "forest_category", F.get(F.map_keys("host"), F.lit(0)).alias("host_class"))


def observations_clean(s, d):
    made = observations.clean(a.observations(s, d))
    return made.select("id", "species", "phase", "is_blank", "id_verified", F.round("weight_g", 4).alias("weight_g"), "error")


def observation_cells(s, d):
    return observations.assign_cells(observations.clean(a.observations(s, d))).select("id", "static_cell_id", "meteo_cell_id")


def observation_pins(s, d):
    made = observations.pins(observations.clean(a.observations(s, d)).where("error IS NULL"))
    return made.select("id", "species", "phase", F.round("weight_g", 4).alias("weight_g"), "is_blank", "photo")


def occurrence_summary(s, d):
    """Observations as occurrences: count and years by species, at most 1000 by time."""
    rows = a.observations(s, d).where("x IS NOT NULL AND species IS NOT NULL")
    capped = rows.withColumn("rn", F.row_number().over(_newest())).where("rn <= 1000")
    return capped.groupBy("species").agg(F.count("*").alias("n"), F.min(F.year("ts_submit")).alias("first_year"), F.max(F.year("ts_submit")).alias("last_year"))


def _newest():
    from pyspark.sql import Window

    return Window.partitionBy("species").orderBy("ts_submit", "id")


def geojson_spots(s, d):
    return publish.spot_collections(spots.top_spots(scored(s, d), phases(s, d), "both"))


def geojson_phases(s, d):
    return publish.phase_features(spots.phases_by_cell(scored(s, d), phases(s, d)))


def host_coverage(s, d):
    """How many cells of each species' hosts there are: host weights exploded and joined by class."""
    cells = a.cells(s, d).join(F.broadcast(p.crosswalk(s)), F.col("forest_code") == F.col("code"), "left").select("cell_key", F.explode_outer(F.map_keys("host")).alias("cls"))
    hosts = p.profiles(s).select("species", F.explode("host_genera").alias("cls", "weight"))
    return cells.join(hosts, "cls").groupBy("species").agg(F.count("*").alias("n_cells"), F.round(F.sum("weight"), 4).alias("weight"))


def gap_report_counts(s, d):
    made = archive_gaps(s, d)
    return made.agg(F.count("*").alias("n_gaps"), F.count_if(F.col("last_date").isNull()).alias("n_empty"))


QUERIES = {
    f.__name__: f
    for f in (
        static_suitability, static_breakdown, map_stats, map_topk, species_subset, custom_weights, meteo_daily, meteo_asof, meteo_features, meteo_history,
        readiness, readiness_breakdown, phase_by_cell, phase_counts, combined_prediction, candidate_cells, candidate_cells_capped, archive_upsert, archive_status,
        archive_gaps, backfill_todo, gap_report_counts, boyce_by_species, boyce_curve, boyce_delta, terrain_stencil, terrain_seamless, regrid_seamless, raster_scan, forest_layers, soil_ph_sample, canopy_sample,
        landcover_fraction, tiles_with_forest, scene_indices, scene_median, canopy_stats, canopy_calibration, canopy_histogram, geology_class,
        geology_nearest, geology_merged, forest_host, layer_merge, suitability_at, cell_ids, cell_centers, cell_polygons, projected_round_trip, homolosine,
        quantised_grid, colour_grid, point_lookup, regrid_nearest, regrid_bilinear, observations_clean, observation_cells, observation_pins,
        occurrence_summary, geojson_spots, geojson_phases, host_coverage, tile_lookup, terrain_at, landcover_at, landcover_window, forest_regions, served_rows, overlay_grid,
        suitability_table, species_list, species_menu, grid_cells, map_cells, grid_dimensions, named_places, scene_selection, random_validation, geojson_pins, overlay_bounds, tile_manifest, soil_extent, occurrence_ingest, geojson_occurrences, polygon_ingest, polygon_ingest_counters, polygon_repair, polygon_repair_counters, stream_daily,
        stream_phases, stream_features, stream_gaps, stream_observations, hourly_feed, feed_mismatches, ingest_windows, polygon_table, canopy_table, species_validation, profile_quality,
    )
} | {f"top_spots_{mode}": _top(mode) for mode in ("static", "dynamic", "both")}
