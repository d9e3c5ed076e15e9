import numpy as np
from pyspark.sql import functions as F

from hyphaspark.functions import grid, projection
from hyphaspark.operators import evaluate, rasters, vectors
from hyphaspark.sources import adapters


def test_cells(spark):
    rows = spark.createDataFrame([(45.86, 11.77), (45.8603, 11.77), (46.30, 11.60)], "lat double, lon double")
    s, m = grid.assign(F.col("lat"), F.col("lon"))
    a, near, far = rows.select(s.alias("s"), m.alias("m")).collect()
    assert (a.s, a.m) == ("s100_7150_50822", "m2200_325_2310") and near.s != far.s
    lat, lon = grid.center(F.lit(a.s))
    again = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).select(*[c.alias(n) for n, c in zip("sm", grid.assign(F.col("lat"), F.col("lon")), strict=True)]).first()
    assert again.s == a.s
    ring = spark.range(1).select(grid.polygon(F.lit(a.m)).alias("r")).first().r
    assert len(ring) == 5 and ring[0] == ring[-1]


def test_round_trip_and_grids(spark):
    rows = spark.range(400).select((45.2 + F.col("id") % 20 / 10.0).alias("lat"), (10.35 + F.floor(F.col("id") / 20) / 7.2).alias("lon"))
    x, y = projection.utm_forward(F.col("lat"), F.col("lon"))
    lat, lon = projection.utm_inverse(F.col("x"), F.col("y"))
    worst = rows.select("lat", "lon", x.alias("x"), y.alias("y")).select(F.max(F.abs(lat - F.col("lat")) + F.abs(lon - F.col("lon"))).alias("e")).first().e
    assert worst < 1e-8
    assert grid.static_grid(spark).count() == 5_015_354 and grid.map_grid(spark).count() == 1_253_278
    assert tuple(grid.dimensions(spark).first()) == (2086, 2242, 4_676_812)


def test_terrain_on_planes(spark):
    # The bearing is that of (-dz/dx, -dz/dy) with y going south: a plane that falls to the north is "warm".
    for gx, gy, want in ((0.0, 0.0, "neutral"), (0.0, -0.5, "warm"), (0.0, 0.5, "cool"), (-0.5, 0.0, "neutral")):
        # z rises by gx to the east and by gy to the north
        rows = spark.createDataFrame([(1, r, c, 100.0 + 10 * gx * c - 10 * gy * r) for r in range(5) for c in range(5)], "tile int, row int, col int, value double")
        out = rasters.terrain(rows, F.lit(10.0), F.lit(10.0), 5).collect()
        slope = np.degrees(np.arctan(np.hypot(gx, gy)))
        assert len(out) == 9 and all(abs(o.slope_deg - slope) < 0.06 for o in out)
        assert {o.aspect for o in out} == {want}


def test_lithology(spark):
    want = ["calcareous", "calcareous", "acidic", "acidic", "acidic", "neutral", "neutral", "calcareous", "acidic", "neutral", "calcareous", "acidic", "neutral"]
    rows = spark.createDataFrame([(i, r, d) for i, (r, d) in enumerate(adapters.LITHOLOGIES)], "i int, region string, descr string")
    assert [r.c for r in rows.orderBy("i").select(vectors.lithology_class(F.col("descr"), F.col("region")).alias("c")).collect()] == want


RINGS = "poly_id int, attr string, region string, rings array<array<struct<x: double, y: double>>>"


def test_holes_and_parts(spark):
    box = lambda x, y, a: [(x - a, y - a), (x + a, y - a), (x + a, y + a), (x - a, y + a), (x - a, y - a)]
    rings = [box(0.0, 0.0, 30000.0), box(0.0, 0.0, 10000.0), box(0.0, 0.0, 3000.0), box(50000.0, 0.0, 1000.0)]  # a hole, an island in it, a part
    polys = spark.createDataFrame([(1, "a", "xx", rings)], RINGS)
    spots = {"land": (20000.0, 5000.0), "hole": (5000.0, 0.0), "shore": (9000.0, 0.0), "island": (0.0, 100.0), "part": (50000.0, 10.0), "between": (40000.0, 0.0), "edge": (10000.0, 0.0), "corner": (30000.0, 30000.0)}
    points = spark.createDataFrame([(k, *v) for k, v in spots.items()], "k string, x double, y double")
    assert {r.k for r in vectors.containing(points, polys, "k").collect()} == {"land", "island", "part"}
    found = {r.k: r.fallback for r in vectors.located(points, polys, "k").collect()}
    assert found == {"land": False, "island": False, "part": False, "hole": True, "shore": True, "edge": True, "corner": True}
    assert {r.k for r in vectors.masked(points, polys, ["k"]).collect()} == {"land", "island", "part"}
    assert {r.soil_ph for r in vectors.geology(points, polys, "k").collect()} == {None}  # a region without keywords


def test_polygons(spark):
    square = [(0.0, 0.0), (4000.0, 0.0), (4000.0, 4000.0), (0.0, 4000.0), (0.0, 0.0)]
    polys = spark.createDataFrame([(2, "b", "tn", [square]), (1, "a", "tn", [[(x + 1000, y) for x, y in square]])], RINGS)
    points = spark.createDataFrame([(1, 500.0, 500.0), (2, 2000.0, 500.0), (3, 0.0, 2000.0), (4, -1000.0, 100.0), (5, -9000.0, 0.0)], "k int, x double, y double")
    assert {r.k: r.poly_id for r in vectors.containing(points, polys, "k").collect()} == {1: 2, 2: 1}
    assert {r.k: (r.poly_id, round(r.dist)) for r in vectors.nearest(points.where("k >= 3"), polys, "k").collect()} == {3: (2, 0), 4: (2, 1000)}
    made = {r.k: r.geology_fallback for r in vectors.geology(points, polys, "k").collect()}
    assert made == {1: False, 2: False, 3: True, 4: True}


def test_canopy_points(spark):
    rows = spark.createDataFrame([(0.85, 0.60), (0.45, 0.18), (0.80, 0.20), (None, 0.5)], "ndvi double, nbr double")
    high, low, mixed, none = (r.c for r in rows.select(rasters.canopy_alive(F.col("ndvi"), F.col("nbr")).alias("c")).collect())
    assert high > 0.9 and low < 0.1 and mixed < 0.4 and none is None


def test_boyce(spark):
    rng = np.random.default_rng(42)
    bg, good, chance = rng.random(5000), rng.beta(5, 1.5, 500), rng.random(500)
    rows = [(s, k, float(v)) for s, pres in (("good", good), ("chance", chance)) for k, vs in (("bg", bg), ("pres", pres)) for v in vs] + [("flat", "bg", 0.5), ("flat", "pres", 0.5)]
    out = {r.species: r.boyce for r in evaluate.boyce(spark.createDataFrame(rows, "species string, kind string, score double")).collect()}
    assert out["good"] > 0.5 and abs(out["chance"]) < 0.5 and np.isnan(out["flat"])
    lo, hi = min(bg.min(), good.min()), max(bg.max(), good.max())
    w = (hi - lo) * 0.1
    pe = []
    for c in np.linspace(lo + w / 2, hi - w / 2, 100):
        e = np.mean((bg >= c - w / 2) & (bg <= c + w / 2))
        if e > 0:
            pe.append(np.mean((good >= c - w / 2) & (good <= c + w / 2)) / e)
    ranks = np.argsort(np.argsort(pe, kind="stable"), kind="stable")
    assert abs(out["good"] - np.corrcoef(np.arange(len(pe)), ranks)[0, 1]) < 1e-3
