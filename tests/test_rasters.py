"""Summed-area land cover, halos between tiles, stored rasters and landed polygon files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyphaspark.operators import rasters
from hyphaspark.sources import layer_tables, polygon_files


def frame(spark, array, names="tile int, row int, col int, value double", tile=1):
    rows = [(tile, r, c, array[r, c].item()) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, names)


def test_landcover_in_real_windows(spark):
    """A window of 0.0025 degrees both ways over pixels of 10 m holds some 3,600; four lookups a point give its shares."""
    rng = np.random.default_rng(1)
    n, d = 200, 1 / 12000
    cover = rng.choice([0, 10, 30, 50], (n, n), p=[0.2, 0.4, 0.3, 0.1])
    cover[:70, :70] = 0
    summed = rasters.summed_area(frame(spark, cover, "tile int, row int, col int, landcover int")).cache()
    points = [(k, 11.0 + float(rng.uniform(0, n * d)), 46.0 - float(rng.uniform(0, n * d))) for k in range(150)] + [(900, 11.0, 46.0 - 1e-9), (901, 11.0 + n * d - 1e-9, 46.0 - n * d + 1e-9), (902, 11.0 + 35 * d, 46.0 - 35 * d)]
    tiles = spark.createDataFrame([(1, 11.0, 46.0, d, d, n, n)], "tile int, x0 double, y0 double, dx double, dy double, nx int, ny int")
    placed = rasters.on_tiles(spark.createDataFrame(points, "k int, lon double, lat double"), tiles, "k")
    got = {r.k: (r.forest_fraction, r.grassland_fraction) for r in rasters.cover_at(placed, summed, "k").collect()}
    assert len(got) == len(points)
    centre = (np.arange(n) + 0.5) * d
    most = 0
    for k, lon, lat in points:
        part = cover[np.abs(46.0 - centre - lat) <= 0.0025][:, np.abs(11.0 + centre - lon) <= 0.0025]
        known = np.count_nonzero(part)
        most = max(most, part.size)
        assert got[k] == ((np.count_nonzero(part == 10) / known, np.count_nonzero(part == 30) / known) if known else (None, None)), k
    assert most >= 3500 and got[902] == (None, None)


def cut(spark, array, size):
    """A raster as tiles of ``size``, and their layout."""
    rows, layout = [], []
    for ty in range(array.shape[0] // size):
        for tx in range(array.shape[1] // size):
            tile = 100 + ty * 10 + tx
            layout.append((tile, tx, ty, size, size))
            rows += [(tile, r, c, float(array[ty * size + r, tx * size + c])) for r in range(size) for c in range(size)]
    return spark.createDataFrame(rows, "tile int, row int, col int, value double"), spark.createDataFrame(layout, "tile int, tx int, ty int, nx int, ny int")


def test_halo_makes_seams_vanish(spark):
    rng = np.random.default_rng(3)
    array = rng.uniform(0, 100, (24, 16)).round(1)
    array[7, 5] = -9999.0
    tiles, layout = cut(spark, array, 8)
    place = lambda r: (r.row + 8 * ((r.tile - 100) // 10), r.col + 8 * ((r.tile - 100) % 10))
    whole = frame(spark, array)
    # one raster of 24 rows and 16 columns: its own border and the nodata pixel's neighbours have none
    want = {(r.row, r.col): (r.elevation_m, r.slope_deg, r.aspect) for r in rasters.terrain(whole, F.lit(30.0), F.lit(30.0), 1000, -9999.0, rim=0).collect()}
    got = {place(r): (r.elevation_m, r.slope_deg, r.aspect) for r in rasters.terrain_seamless(tiles, layout, F.lit(30.0), F.lit(30.0), 8, -9999.0).collect()}
    assert got == want and len(want) == 22 * 14 - 9
    spots = [(k, float(rng.uniform(0, 24)), float(rng.uniform(0, 16))) for k in range(300)] + [(901, 8.0, 8.0), (902, 16.0, 0.25), (903, 7.99, 8.01)]
    target = spark.createDataFrame([(1, k, fy, fx) for k, fy, fx in spots], "tile int, k int, fy double, fx double")
    parts = spark.createDataFrame([(100 + int(fy // 8) * 10 + int(fx // 8), k, fy % 8, fx % 8) for k, fy, fx in spots], "tile int, k int, fy double, fx double")
    one = {r.k: round(r.value, 6) for r in rasters.regrid_bilinear(whole, target, ["k"]).collect()}
    many = {r.k: round(r.value, 6) for r in rasters.regrid_bilinear(rasters.with_halo(tiles, layout), parts, ["k"]).collect()}
    assert one == many
    assert rasters.with_halo(tiles, layout, 2).count() == 24 * 16 + sum(min(24, 8 * y + 10) - max(0, 8 * y - 2) for y in range(3)) * sum(min(16, 8 * x + 10) - max(0, 8 * x - 2) for x in range(2)) - 24 * 16


def test_curve_and_ranges(spark):
    rng = random.Random(4)
    points = [(rng.randrange(1 << 16), rng.randrange(1 << 16)) for _ in range(200)] + [(0, 0), (65535, 65535)]
    got = {(r.x, r.y): r.k for r in spark.createDataFrame(points, "x int, y int").select("x", "y", layer_tables.morton(F.col("x"), F.col("y")).alias("k")).collect()}
    key = lambda x, y: sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(16))
    assert got == {(x, y): key(x, y) for x, y in points}
    for _ in range(60):
        x0, y0 = rng.randrange(500), rng.randrange(500)
        x1, y1 = x0 + rng.randrange(40), y0 + rng.randrange(40)
        ranges = layer_tables.key_ranges(x0, y0, x1, y1)
        assert len(ranges) <= 32 and all(a <= b for a, b in ranges) and all(p[1] < q[0] for p, q in zip(ranges, ranges[1:]))
        keys = {key(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        assert all(any(a <= k <= b for a, b in ranges) for k in keys)
        assert sum(b - a + 1 for a, b in ranges) <= 8 * len(keys) + 64


def test_scan_reads_the_zones_of_its_box(spark, tmp_path):
    path = str(tmp_path / "rasters")
    tiles = spark.range(900).selectExpr("CAST(id AS INT) AS tile", "10.0D + id % 30 AS x0", "20.0D + id DIV 30 AS y0", "0.25D AS dx", "0.25D AS dy", "4 AS nx", "4 AS ny")
    pixels = tiles.selectExpr("tile", "explode(sequence(0, 15)) AS p").selectExpr("tile", "p DIV 4 AS row", "p % 4 AS col", "tile * 100.0D + p AS value")
    layer_tables.write_raster(pixels, tiles, path, "dem")
    layer_tables.write_raster(pixels.where("tile < 5"), tiles, path, "soil")
    box = (14.3, 24.1, 17.2, 26.6)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    made = layer_tables.scan_raster(spark, path, "dem", box)
    got = {(r.tile, r.row, r.col, r.value) for r in made.collect()}
    want = {(r.tile, r.row, r.col, r.value) for r in pixels.join(tiles, "tile").where("x0 + (col + 0.5D) * dx >= 14.3 AND x0 + (col + 0.5D) * dx < 17.2 AND y0 - (row + 0.5D) * dy >= 24.1 AND y0 - (row + 0.5D) * dy < 26.6").collect()}
    assert got == want and len(want) > 50
    every = spark.read.parquet(path).inputFiles()
    run = made._jdf.queryExecution()
    run.toRdd().count()
    scan = run.executedPlan().collectLeaves().head()
    assert 0 < scan.metrics().apply("numFiles").value() < len(every) / 3  # folders of other zones and layers are not read
    plan = run.executedPlan().toString()
    assert "PartitionFilters: [" in plan and "zone" in plan.split("PartitionFilters: [")[1].split("]")[0] and "key" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert layer_tables.scan_raster(spark, path, "soil", (-179.0, -80.0, 179.0, 80.0)).count() == 80
    with pytest.raises(ValueError):
        layer_tables.scan_raster(spark, path, "canopy", box)
    layer_tables.write_raster(pixels.where("tile = 7"), tiles, path, "dem")  # in place of the layer's tiles of its zones
    assert layer_tables.scan_raster(spark, path, "dem", (-179.0, -80.0, 179.0, 80.0)).where("tile = 7").count() == 16


def test_polygon_files(spark, tmp_path):
    square = lambda x, y: [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]
    feature = lambda i, props, ring, **more: {"type": "Feature", "id": i, "geometry": {"type": "Polygon", "coordinates": ring}, "properties": props, **more}
    metres = {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32632"}}}
    (tmp_path / "b").mkdir()
    (tmp_path / "a.geojson").write_text("\n".join([json.dumps(feature(1, {"CATEGORIA": " beech "}, square(700000.0, 5100000.0), **metres)), "", json.dumps(feature(2, {"other": "x"}, square(700010.0, 5100000.0), **metres))]))
    (tmp_path / "b" / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1, {"tipo_fores": "larch", "area": 3}, square(11.0, 46.0)), {"type": "Feature", "id": 3, "geometry": None, "properties": {"tipo_fores": "x"}}]}))
    made, counters = polygon_files.read(spark, str(tmp_path), ["CATEGORIA", "tipo_fores"])
    rows = {r.poly_id: r for r in made.collect()}
    assert {k: r.attr for k, r in rows.items()} == {1: "beech", (1 << 40) + 1: "larch"}
    assert [(p.x, p.y) for p in rows[1].rings[0]][0] == (700000.0, 5100000.0)
    corner = rows[(1 << 40) + 1].rings[0][0]
    assert abs(corner.x - 654870) < 100 and abs(corner.y - 5096000) < 1500
    back = made.where("attr = 'larch'").select(polygon_files.to_degrees(F.col("rings")).alias("r")).first().r[0]
    assert sorted((round(p.x, 7), round(p.y, 7)) for p in back) == sorted(map(tuple, square(11.0, 46.0)[0]))
    assert counters.first().asDict() == {"n_features": 4, "n_no_geometry": 1, "n_invalid": 0, "n_unnamed": 1, "n_repaired": 0}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        polygon_files.read(spark, str(tmp_path / "none"), ["CATEGORIA"])


def test_summed_area_is_not_broadcast(spark):
    """Exploded pixels look as small as the table that they come from; the driver must not collect them."""
    pixels = spark.range(2).selectExpr("CAST(id AS INT) AS tile", "explode(sequence(0, 63)) AS row").selectExpr("tile", "row", "explode(sequence(0, 63)) AS col").selectExpr("*", "10 AS landcover")
    placed = spark.createDataFrame([(k, 0, 11.001, 45.999, 3, 3, 1e-3, 1e-3, 11.0, 46.0, 64, 64) for k in range(3)], "k int, tile int, lon double, lat double, row int, col int, dx double, dy double, x0 double, y0 double, nx int, ny int")
    made = rasters.cover_at(placed, rasters.summed_area(pixels), "k")
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in made.collect()} == {(k, 1.0, 0.0) for k in range(3)}


def test_points_meet_only_tiles_nearby(spark):
    """Many small tiles in one degree: a point meets those around it, not all of them."""
    tiles = spark.range(900).selectExpr("id AS tile", "10.0D + (id % 30) * 0.02D AS x0", "46.0D + (id DIV 30 + 1) * 0.02D AS y0", "0.0025D AS dx", "0.0025D AS dy", "8 AS nx", "8 AS ny")
    points = spark.range(2000).selectExpr("id AS k", "10.0D + (id * 7919 % 2003) / 2003.0D * 0.6D AS lon", "46.0D + (id * 104729 % 2003) / 2003.0D * 0.6D AS lat").cache()
    got = rasters.on_tiles(points, tiles, "k")
    want = {(r.k, r.tile) for r in points.join(tiles, F.expr("lon >= x0 AND lon < x0 + nx * dx AND lat < y0 AND lat >= y0 - ny * dy")).groupBy("k").agg(F.min("tile").alias("tile")).collect()}
    run = got._jdf.queryExecution()
    assert {(r.k, r.tile) for r in got.collect()} == want and len(want) > 1900
    assert "/ 0.02)" in run.optimizedPlan().toString()  # squares of a tile's side


def test_terrain_at_sends_a_point_once(spark):
    """Terrain at points is the stencil of their pixels, with nodata, gaps and borders left out; no row is made for each neighbour."""
    rng = np.random.default_rng(4)
    n, d = 12, 0.001
    values = rng.integers(0, 50, (n, n)).astype(float)
    pixels = frame(spark, values).where("NOT (row = 4 AND col = 7)")
    tiles = spark.createDataFrame([(1, 11.0, 46.0, d, d, n, n)], "tile int, x0 double, y0 double, dx double, dy double, nx int, ny int")
    points = spark.createDataFrame([(int(r * n + c), 11.0 + (c + 0.5) * d, 46.0 - (r + 0.5) * d) for r in range(n) for c in range(n)], "k int, lon double, lat double")
    made = rasters.terrain_at(rasters.on_tiles(points, tiles, "k"), pixels, "k", nodata=0.0)
    want = {}
    for r in range(1, n - 1):
        for c in range(1, n - 1):
            z = values[r - 1 : r + 2, c - 1 : c + 2]
            if (z == 0).any() or (abs(r - 4) <= 1 and abs(c - 7) <= 1):
                continue
            lat = np.radians(46.0 - (r + 0.5) * d)
            x = (z[:, 2] * [1, 2, 1]).sum() - (z[:, 0] * [1, 2, 1]).sum()
            y = (z[2] * [1, 2, 1]).sum() - (z[0] * [1, 2, 1]).sum()
            want[r * n + c] = (z[1, 1], float(np.degrees(np.arctan(np.hypot(x / (8 * d * rasters.METRES_LON * np.cos(lat)), y / (8 * d * rasters.METRES_LAT))))))
    got = {r.k: (r.elevation_m, r.slope_deg) for r in made.collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) <= 0.0501 for k, v in want.items())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") <= 2  # the bins of tiles alone


def sent_rows(spark, run):
    """Rows that the stages of ``run`` wrote to be exchanged."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    old = {(x.stageId(), x.attemptId()) for x in (stages().apply(k) for k in range(stages().size()))}
    run()
    found = stages()
    return sum(x.shuffleWriteRecords() for x in (found.apply(k) for k in range(found.size())) if (x.stageId(), x.attemptId()) not in old)


def test_cover_sends_blocks_and_not_pixels(spark):
    """Pixels become bits before they are sent; tiles that are no whole blocks, rows and pixels that are not there and windows over several blocks count alike."""
    rng = np.random.default_rng(5)
    ny, nx, d, half = 150, 90, 0.0001, 0.004
    cover = rng.choice([0, 10, 30, 50], (4, ny, nx), p=[0.2, 0.4, 0.3, 0.1])
    cover[:, 10:20], cover[:, 70, :], cover[:, :, 88:] = 0, 0, 0
    rows = [(t, r, c, cover[t, r, c].item()) for t in range(4) for r in range(ny) for c in range(nx) if not (10 <= r < 20 or r == 70 or c >= 88)]
    pixels = spark.createDataFrame(rows, "tile int, row int, col int, landcover int").coalesce(4).cache()
    tiles = spark.createDataFrame([(t, 11.0 + t, 46.0, d, d, nx, ny) for t in range(4)], "tile int, x0 double, y0 double, dx double, dy double, nx int, ny int")
    points = [(k, 11.0 + k % 4 + float(rng.uniform(0, nx * d)), 46.0 - float(rng.uniform(0, ny * d))) for k in range(300)]
    placed = rasters.on_tiles(spark.createDataFrame(points, "k int, lon double, lat double"), tiles, "k")
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # points and tiles, each once
    placed = placed.cache()
    assert placed.count() == 300 and pixels.count() == len(rows)
    got = {}
    run = lambda: got.update({r.k: (r.forest_fraction, r.grassland_fraction) for r in rasters.cover_at(placed, rasters.summed_area(pixels), "k", half).collect()})
    assert sent_rows(spark, run) < len(rows) / 5
    for k, lon, lat in points:
        part = cover[k % 4][np.abs(46.0 - (np.arange(ny) + 0.5) * d - lat) <= half][:, np.abs(11.0 + k % 4 + (np.arange(nx) + 0.5) * d - lon) <= half]
        known = np.count_nonzero(part)
        assert got[k] == (np.count_nonzero(part == 10) / known, np.count_nonzero(part == 30) / known), k
    assert len(got) == 300
