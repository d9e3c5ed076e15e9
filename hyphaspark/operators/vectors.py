"""Polygons as ring tables: point in polygon, nearest polygon, lithology classes.

A polygon has ``rings``: the outer and inner rings of all its parts, closed, in any order; what an even number
of them holds is outside, so holes and several parts need nothing special (``repair`` makes rings of shapes that cross or
overlap themselves). Space is cut into square bins. A bin of a polygon holds the edges that pass through it and the parity of one
reference point, that is whether the polygon holds that point; bins that lie inside without an edge have the parity alone. So
edge rows are linear in the edges, however many bins a polygon spans. A point falls into one bin, an equi-join
finds the polygons there, and the local edges between the point and the reference point turn its parity into the point's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of lithologies by region.
KEYWORDS = {
    "tn": {
        "calcareous": ["CALCARE", "CALCARI", "CALCAREN", "DOLOMIA", "DOLOMIE", "CARNIOLA", "CALCISCIST", "OOLIT", "MAIOLICA", "BIANCONE", "SCAGLIA", "CORNA", "MARMO", "MARMI", "TRAVERTINO", "ENCRINITE", "ROSSO AMMONITICO", "SASS DE LA LUNA", "SELCIFERO", "SCILIAR", "SCHLERN", "CONTRIN", "LATEMAR", "MENDOLA", "SERLA", "CASSIANA"],
        "acidic": ["GRANIT", "GRANODIOR", "MONZOGRAN", "APLIT", "PEGMATIT", "PORFI", "FILLAD", "GNEISS", "MICASCIST", "SCISTI", "QUARZIT", "QUARZO", "RIOLIT", "DACIT", "FELSIT", "IGNIMBRIT", "TUFO", "TUFF", "VULCAN", "ATESIN", "GARGAZZONE", "AUCCIA", "PIROCLAST", "LATIT", "TONALIT", "SIENIT", "LEUCOMONZONIT", "VERRUCANO", "MILONIT"],
    },
    "ve": {
        "calcareous": ["CALCAR", "DOLOMI", "CALCAREN", "ENCRINIT", "OOLIT", "MARMO", "CALCESCIST", "CALCISCIST"],
        "acidic": ["METAMORF", "FILLAD", "MICASCIST", "GNEISS", "SCISTI", "QUARZIT", "MIGMATIT", "RIOLIT", "IGNIMBRIT"],
    },
}
KEYWORDS["bz"] = KEYWORDS["tn"]
BIN, RADIUS = 2200.0, 2000.0
SPOT = (0.381966011250105, 0.414213562373095)  # where the reference point lies in a bin, so that edges on round coordinates miss it, slanting ones too
EDGES = "array<struct<ax: double, ay: double, bx: double, by: double>>"


def lithology_class(descr: Column, region: Column) -> Column:
    """calcareous, acidic or neutral: the first keyword list with a word in the description. Null without a
    description or for a region that has no lists."""
    upper, out = F.upper(descr), F.lit(None).cast("string")
    for name, lists in KEYWORDS.items():
        found = F.when(upper.rlike("|".join(lists["calcareous"])), "calcareous").when(upper.rlike("|".join(lists["acidic"])), "acidic").otherwise("neutral")
        out = F.when(region == name, found).otherwise(out)
    return F.when(descr.isNotNull(), out)


def edges_of(polygons: DataFrame) -> DataFrame:
    """poly_id, attr, region and ax, ay, bx, by of every edge of every ring."""
    rows = polygons.select("poly_id", "attr", "region", F.explode("rings").alias("r"))
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    return rows.select("poly_id", "attr", "region", F.explode(pairs).alias("e")).select("poly_id", "attr", "region", "e.*")


def crossing_x(y: Column, e=F.col) -> Column:
    """Where the edge, or its line, has this y."""
    ax, ay, bx, by = (e(c) for c in ("ax", "ay", "bx", "by"))
    return (bx - ax) * F.try_divide(y - ay, by - ay) + ax


def by_bins(edges: DataFrame, size: Column | float, margin: float = 0.0) -> DataFrame:
    """A row of ``edges`` for each bin that the edge comes within ``margin`` of: bin_x, bin_y. In each row of bins
    only the part of the edge there counts, so a long slanting edge takes bins along its way, not those of its box."""
    size = F.lit(size) if isinstance(size, float) else size
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    slack = size * 1e-9 + margin
    rows = edges.withColumn("bin_y", F.explode(F.sequence(F.floor((lo - slack) / size).cast("long"), F.floor((hi + slack) / size).cast("long"))))
    bottom, top = F.greatest(lo, F.col("bin_y") * size - slack), F.least(hi, (F.col("bin_y") + 1) * size + slack)
    flat = F.col("ay") == F.col("by")
    x = lambda y, c: F.when(flat, F.col(c)).otherwise(F.greatest(F.least("ax", "bx"), F.least(F.greatest("ax", "bx"), crossing_x(y))))
    ends = [x(bottom, "ax"), x(top, "bx")]
    return rows.withColumn("bin_x", F.explode(F.sequence(F.floor((F.least(*ends) - slack) / size).cast("long"), F.floor((F.greatest(*ends) + slack) / size).cast("long"))))


def parity_bins(polygons: DataFrame, size: float = BIN) -> DataFrame:
    """bin_x, bin_y, poly_id, attr, region, edges (those that pass through the bin), odd (whether the polygon holds
    the bin's reference point): a row for each bin that the polygon's area or border touches."""
    cx, cy = (F.col("bin_x") + SPOT[0]) * size, (F.col("bin_y") + SPOT[1]) * size
    rows = by_bins(edges_of(polygons), size)
    at = F.when((F.col("ay") > cy) != (F.col("by") > cy), crossing_x(cy))  # on the line through the reference points
    here = F.floor(at / size) == F.col("bin_x")
    bins = rows.groupBy("poly_id", "bin_y", "bin_x").agg(
        F.first("attr").alias("attr"), F.first("region").alias("region"), F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"),
        F.count_if(here).alias("n"), F.count_if(here & (cx < at)).alias("n_right"),
    )
    w = Window.partitionBy("poly_id", "bin_y").orderBy(F.desc("bin_x"))
    bins = bins.withColumns({"beyond": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "next": F.lag("bin_x").over(w)})
    odd = (F.col("beyond") + F.col("n_right")) % 2 == 1
    inner = F.when((F.col("beyond") % 2 == 1) & (F.col("next") > F.col("bin_x") + 1), F.sequence(F.col("bin_x") + 1, F.col("next") - 1))
    whole = bins.select(F.explode(inner).alias("bin_x"), "bin_y", "poly_id", "attr", "region", F.array().cast(EDGES).alias("edges"), F.lit(True).alias("odd"))
    return bins.select("bin_x", "bin_y", "poly_id", "attr", "region", "edges", odd.alias("odd")).unionByName(whole)


def inside(x: Column, y: Column, size: float, bin: str = "") -> Column:
    """Whether the polygon of a bin holds a point of it: the parity of the reference point, turned by each edge on the way
    from there, up or down to the point's height and along to the point. Points on an edge are outside. ``bin`` stands before
    the names of the bin's columns."""
    cx, cy = (F.col(f"{bin}bin_x") + SPOT[0]) * size, (F.col(f"{bin}bin_y") + SPOT[1]) * size

    def turns(e: Column) -> Column:
        along = ((e["ay"] > y) != (e["by"] > y)) & ((x < (xc := crossing_x(y, lambda c: e[c]))) != (cx < xc))
        yc = (e["by"] - e["ay"]) * F.try_divide(cx - e["ax"], e["bx"] - e["ax"]) + e["ay"]
        up = ((e["ax"] > cx) != (e["bx"] > cx)) & ((y < yc) != (cy < yc))
        return along.cast("int") + up.cast("int")

    on = lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
    met = F.aggregate(f"{bin}edges", F.col(f"{bin}odd").cast("int"), lambda n, e: F.when((n < 0) | on(e), -1).otherwise(n + turns(e)))
    return (met > 0) & (met % 2 == 1)


def distance(x: Column, y: Column, edges: str = "edges") -> Column:
    """Distance to the nearest edge."""

    def of(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        along = F.coalesce(F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(e["ax"] + t * dx - x, e["ay"] + t * dy - y)

    return F.array_min(F.transform(edges, of))


def _in_bins(points: DataFrame, key: str, size: float) -> DataFrame:
    return points.select(key, "x", "y").withColumns({"bin_x": F.floor(F.col("x") / size).cast("long"), "bin_y": F.floor(F.col("y") / size).cast("long")})


def least_bins(bins: DataFrame) -> DataFrame:
    """The rows of ``parity_bins`` that may decide which polygon with a point has the smallest id: of those of a bin that run alike the one
    with the smallest id, and none with a larger id than one that covers the whole bin. However many polygons lie over each
    other, a bin so holds few of them, unless all differ there and none covers it."""
    alike = bins.groupBy("bin_x", "bin_y", F.array_sort("edges").alias("edges"), "odd").agg(F.min(F.struct("poly_id", "attr", "region")).alias("p"))
    covers = F.min(F.when((F.size("edges") == 0) & F.col("odd"), F.col("p.poly_id"))).over(Window.partitionBy("bin_x", "bin_y"))
    kept = alike.withColumn("cover", covers).where("cover IS NULL OR p.poly_id <= cover")
    return kept.select("bin_x", "bin_y", "p.*", "edges", "odd")


def alike(polygons: DataFrame) -> DataFrame:
    """poly_id, attr, region, rings: of polygons with the same rings the one with the smallest id, which decides for all of them wherever the
    smallest id counts. Rows of one id are one polygon."""
    whole = polygons.groupBy("poly_id").agg(F.first("attr").alias("attr"), F.first("region").alias("region"), F.array_sort(F.flatten(F.collect_list("rings"))).alias("rings"))
    return whole.groupBy("rings").agg(F.min(F.struct("poly_id", "attr", "region")).alias("p")).select("p.*", "rings")


def held(points: DataFrame, polygons: DataFrame, key: str, size: float = BIN) -> DataFrame:
    """key, x, y, and p: poly_id, attr, region of the polygon that contains the point (the smallest id, if several), or null."""
    met = _in_bins(points, key, size).join(least_bins(parity_bins(alike(polygons), size)).hint("merge"), ["bin_x", "bin_y"], "left")
    here = F.when(F.col("poly_id").isNotNull() & inside(F.col("x"), F.col("y"), size), F.struct("poly_id", "attr", "region"))
    return met.select(key, F.struct("x", "y").alias("at"), here.alias("p")).groupBy(key).agg(F.first("at").alias("at"), F.min("p").alias("p")).select(key, "at.*", "p")


def containing(points: DataFrame, polygons: DataFrame, key: str, size: float = BIN) -> DataFrame:
    """key, poly_id, attr, region of the polygon that contains each point (the smallest id, if several);
    points outside all polygons drop out."""
    return held(points, polygons, key, size).where("p IS NOT NULL").select(key, "p.*")


def nearest(points: DataFrame, polygons: DataFrame, key: str, radius: float = RADIUS, size: float = BIN) -> DataFrame:
    """key, poly_id, attr, region, dist of the polygon with the nearest edge within ``radius`` (ties: the
    smallest id). A bin holds the edges that come within the radius of it; bins are never sent to all executors, as Spark takes them
    for as small as the polygons."""
    near = by_bins(edges_of(alike(polygons)), size, radius).groupBy("bin_x", "bin_y", "poly_id").agg(F.first("attr").alias("attr"), F.first("region").alias("region"), F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    met = _in_bins(points, key, size).join(near.hint("merge"), ["bin_x", "bin_y"]).withColumn("dist", distance(F.col("x"), F.col("y"))).where(F.col("dist") <= radius)
    return met.groupBy(key).agg(F.min(F.struct("dist", "poly_id", "attr", "region")).alias("p")).select(key, "p.*")


def located(points: DataFrame, polygons: DataFrame, key: str, radius: float = RADIUS, size: float = BIN) -> DataFrame:
    """key, poly_id, attr, region, fallback: the containing polygon (fallback false), else the nearest one. Only
    points outside all polygons are measured, as distances cost most."""
    found = held(points, polygons, key, size)
    near = nearest(found.where("p IS NULL"), polygons, key, radius, size).drop("dist").withColumn("fallback", F.lit(True))
    return found.where("p IS NOT NULL").select(key, "p.*", F.lit(False).alias("fallback")).unionByName(near)


def geology(points: DataFrame, polygons: DataFrame, key: str, radius: float = RADIUS) -> DataFrame:
    """key, soil_ph, geology_descr, geology_fallback: the containing polygon, else the nearest one."""
    made = located(points, polygons, key, radius)
    return made.select(key, lithology_class(F.col("attr"), F.col("region")).alias("soil_ph"), F.col("attr").alias("geology_descr"), F.col("fallback").alias("geology_fallback"))


def masked(pixels: DataFrame, polygons: DataFrame, keys: list[str], size: float = BIN) -> DataFrame:
    """The pixels whose centre (x, y) lies in a polygon. A pixel is met in its bin until the first polygon that holds it."""
    bins = least_bins(parity_bins(polygons, size)).select(F.col("bin_x").alias("_bx"), F.col("bin_y").alias("_by"), F.struct("bin_x", "bin_y", "edges", "odd").alias("_b"))
    at = (F.floor(F.col("x") / size) == F.col("_bx")) & (F.floor(F.col("y") / size) == F.col("_by"))
    return pixels.join(bins, at & inside(F.col("x"), F.col("y"), size, bin="_b."), "left_semi")


def forest_host(points: DataFrame, polygons: DataFrame, crosswalk: DataFrame, key: str) -> DataFrame:
    """key, forest_category, host: the category of the containing polygon and its host map (null if unmapped)."""
    met = containing(points, polygons, key).withColumn("forest_category", F.trim("attr"))
    return met.join(crosswalk, F.col("forest_category") == F.col("code"), "left").select(key, "forest_category", "host")


def lookup_by_coordinates(points: DataFrame, landed: DataFrame) -> DataFrame:
    """Attributes that were landed for points, joined by latitude and longitude with four decimals; of several names at one place
    the first by code point counts."""
    key = lambda: F.format_string("%.4f,%.4f", F.col("lat"), F.col("lon"))
    return points.withColumn("_k", key()).join(landed.groupBy(key().alias("_k")).agg(F.min("name").alias("name")), "_k", "left").drop("_k")
