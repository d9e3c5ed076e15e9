import json
import math

from pyspark.sql import functions as F

from hyphaspark.functions.grid import AREA
from hyphaspark.operators import evaluate, weather
from hyphaspark.plans import queries
from hyphaspark.sources import adapters, archive, feeds, layer_tables, profiles
from hyphaspark.streaming import cell_watch, weather_stream

SF = "/root/testdata/sf0.001"


def text(spark, rows, extra="batch string"):
    return spark.createDataFrame(rows, f"{extra}, value string")


def test_hourly_feed(spark):
    one = {"hourly": {"time": ["2024-08-01T00:00", "2024-08-01T01:00"], "precipitation": [1.0, None], "soil_temperature_6cm": [None, 15.0], "soil_moisture_3_to_9cm": [0.2, 0.3], "temperature_2m": [20.0, 21.0]}}
    docs = text(spark, [("a", json.dumps(one)), ("b", json.dumps([one, one]))])
    rows = feeds.hourly(docs)
    assert rows.count() == 6 and rows.where("batch = 'b' AND location = 1").count() == 2
    asked = spark.createDataFrame([("a", 0, "m1"), ("b", 0, "m2"), ("b", 1, "m3"), ("b", 2, "m4")], "batch string, location int, meteo_cell_id string")
    assert {r.meteo_cell_id for r in feeds.match_requests(asked, rows, ["batch"]).collect()} == {"m1", "m2", "m3"}
    assert [tuple(r) for r in feeds.mismatches(asked, rows, ["batch"]).collect()] == [("b", 3, 2)]
    days = weather.daily(feeds.match_requests(asked, rows, ["batch"])).where("meteo_cell_id = 'm1'").first()
    assert (days.precip_mm, days.soil_temp_c, days.soil_moist) == (1.0, 15.0, 0.25)


def test_polygon_and_occurrence_pages(spark):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = lambda i, g, n: {"id": i, "geometry": g, "properties": {"NAME": n}}
    shape = {"type": "Polygon", "coordinates": [ring]}
    hole = [[0.5, 0.2], [0.8, 0.2], [0.8, 0.4], [0.5, 0.2]]
    parts = text(spark, [("m", json.dumps({"features": [feature(7, {"type": "MultiPolygon", "coordinates": [[ring, hole], [[[5, 5], [6, 6], [5, 5]]], [ring]]}, "m"), feature(8, {"type": "Polygon", "coordinates": [ring, hole]}, "h"), feature(9, {"type": "Point", "coordinates": [0, 0]}, "p")]}))])
    polys, counters = feeds.polygon_pages(parts, "NAME")
    assert {r.poly_id: len(r.rings) for r in polys.collect()} == {7: 1, 8: 2} and counters.first().asDict() == {"n_features": 3, "n_no_geometry": 0, "n_invalid": 1, "n_unnamed": 0, "n_repaired": 1}
    page = {"features": [feature(1, shape, " Granito "), feature(2, None, "x"), feature(3, shape, ""), feature(4, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}, "y"), feature(1, shape, "Granito")]}
    pages = text(spark, [("p", json.dumps(page))])
    polys, counters = feeds.polygon_pages(pages, "NAME")
    assert [(r.poly_id, r.attr) for r in polys.collect()] == [(1, "Granito")] and tuple(counters.first()) == (5, 1, 1, 1, 0)
    assert feeds.polygon_pages(pages, "NAME", True)[0].count() == 2 and feeds.max_object_id(pages).first().max_id == 4
    assert [r.lo for r in feeds.missing_windows(spark, spark.createDataFrame([(0,)], "lo long"), 25, 10).orderBy("lo").collect()] == [10, 20]
    res = {"results": [{"decimalLatitude": 46.0, "decimalLongitude": 11.0, "year": 2020, "key": k} for k in range(5)] + [{"decimalLatitude": None, "key": 9}, {"decimalLatitude": 1.0, "decimalLongitude": 11.0, "key": 10}]}
    occ = feeds.occurrences(spark.createDataFrame([("s", 0, json.dumps(res)), ("s", 1, json.dumps(res))], "species string, page int, value string"), AREA, 7)
    assert occ.count() == 7 and occ.where("gbif_key > 8").count() == 0
    keys = feeds.accepted_key(spark.createDataFrame([("a", '{"usageKey": 1, "acceptedUsageKey": 2}'), ("b", '{"usageKey": 3}')], "species string, value string"))
    assert {r.species: r.taxon_key for r in keys.collect()} == {"a": 2, "b": 3}
    made = occ.limit(1).select(feeds.as_feature(["year", "gbif_key"]).alias("f")).first().f
    assert json.loads(made)["geometry"]["coordinates"] == [11.0, 46.0]
    assert feeds.presences(spark.createDataFrame([(json.dumps({"features": [{"geometry": {"coordinates": [11.0, 46.0]}, "properties": {"species": "s"}}]}),)], "value string")).first().lat == 46.0


def test_manifests(spark):
    tiles = {r.tile for r in feeds.tile_manifest(spark, AREA, 1, "%s%02d_%s%03d").collect()}
    assert len(tiles) == 12 and "N45_E010" in tiles and "N47_E013" in tiles
    assert feeds.tile_manifest(spark, AREA, 3, "%s%02d%s%03d").count() == 2
    box = feeds.projected_box(spark, AREA).first()
    assert box.x0 < box.x1 and box.y0 < box.y1
    a, b = (feeds.background(spark, 500, AREA, 1).repartition(n).orderBy("lat").collect() for n in (1, 5))
    assert a == b and all(AREA["lat_min"] <= r.lat <= AREA["lat_max"] for r in a)
    cat = spark.createDataFrame([(f"s{i}", f"2024-07-{i + 1:02d}", i * 3.0, 10.0, 45.0, 11.0, 46.0) for i in range(20)], "scene_id string, scene_date string, cloud_cover double, lon_min double, lat_min double, lon_max double, lat_max double")
    assert feeds.scenes(cat, "2024-07-02", "2024-07-30", AREA).count() == 8


def test_stream_equals_batch(spark, tmp_path):
    """Late, repeated and shuffled files give the archive that one batch gives."""
    hours = adapters.hourly(spark, SF).select("event_id", "meteo_cell_id", "time", "precip", "soil_temp", "soil_moist")
    rows = hours.orderBy("time").collect()
    source, path = tmp_path / "in", str(tmp_path / "archive")
    source.mkdir()
    step = len(rows) // 4 + 1
    for k in range(4):
        part = rows[k * step : (k + 1) * step] + rows[max(0, k * step - 20) : k * step]  # repeats of the last file
        with open(source / f"{k}.json", "w") as f:
            for r in reversed(part):
                d = r.asDict() | {"time": r.time.isoformat()}
                f.write(json.dumps({k2: v for k2, v in d.items() if v is not None}) + "\n")
    weather_stream.run_archive(weather_stream.read_hours(spark, str(source)), path, str(tmp_path / "cp")).awaitTermination()
    rounded = lambda df: sorted((r.meteo_cell_id, r.date, *(None if v is None else round(v, 6) for v in (r.precip_mm, r.soil_temp_c, r.soil_moist))) for r in df.collect())
    got, want = archive.read(spark, path, weather_stream.ARCHIVE), weather.daily(hours)
    assert [g[:2] for g in rounded(got)] == [w[:2] for w in rounded(want)]
    assert rounded(got) == rounded(want)
    profile, watched = profiles.profiles(spark), hours.select("meteo_cell_id").unionByName(spark.createDataFrame([("m2200_0_0",)], "meteo_cell_id string"))
    weather_stream.run_watch(spark, path, str(tmp_path / "events"), str(tmp_path / "cp2"), profile, watched, files_per_batch=9).awaitTermination()
    events = spark.read.parquet(str(tmp_path / "events"))
    assert events.select("batch").distinct().count() > 2
    streamed = {(r.meteo_cell_id, r.species): (r.state, r.readiness) for r in weather_stream.phases(events, profile).collect()}
    batch = {(r.meteo_cell_id, r.species): (r.state, r.readiness) for r in weather.phases(want, profile).collect()}
    assert streamed == batch
    today = got.agg(F.max("date")).first()[0]
    alerts = {tuple(r) for r in cell_watch.stale(events).collect()}
    assert alerts == {tuple(r) for r in weather.gaps(watched, want, F.lit(today)).collect()} and ("m2200_0_0", None) in alerts


def test_observation_stream(spark, tmp_path):
    raw = adapters.observations(spark, SF)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    weather_stream.capture_observations(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    clean = queries.observations_clean(spark, SF)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == clean.where("error IS NULL").count()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == clean.where("error IS NOT NULL").count()


def test_series_that_a_response_lacks(spark):
    docs = text(spark, [("a", json.dumps({"hourly": {"time": ["2024-08-01T00:00"], "precipitation": [1.0]}}))])
    row = feeds.hourly(docs).first()
    assert (row.precip, row.soil_temp, row.temp) == (1.0, None, None)


def test_layers_of_one_table(spark, tmp_path):
    path = str(tmp_path / "pixels")
    tiles = lambda *numbers, v: spark.createDataFrame([(t, 0, c, v) for t in numbers for c in range(2)], "tile int, row int, col int, value double")
    layer_tables.append_tiles(tiles(1, 2, v=1.0), path, "canopy")
    layer_tables.append_tiles(tiles(2, 3, v=5.0), path, "canopy")
    layer_tables.append_tiles(tiles(2, v=7.0), path, "dem")
    got = {(r.tile, r.value) for r in layer_tables.read(spark, path, "canopy").collect()}
    assert got == {(1, 1.0), (2, 1.0), (3, 5.0)} and layer_tables.read(spark, path, "canopy").count() == 6
    layer_tables.write(tiles(9, v=0.0), path, "canopy")
    assert {r.tile for r in layer_tables.read(spark, path, "canopy").collect()} == {9}
    assert {r.tile for r in layer_tables.read(spark, path, "dem").collect()} == {2}


def test_validation_of_a_species_without_presences(spark):
    maps = spark.createDataFrame([(s, 0, j, j / 10.0) for s in ("a", "b") for j in range(10)], "species string, i int, j int, score double")
    ground = spark.createDataFrame([(float(j), -0.5) for j in range(10)] + [(-5.0, -0.5)], "x double, y double")
    seen = spark.createDataFrame([("a", float(j), -0.5) for j in (6, 7, 8, 8, 9, 9, 9)] + [("a", 50.0, -0.5)], "species string, x double, y double")
    made = {r.species: r for r in evaluate.validate(seen, ground, maps, (0.0, 0.0), 1.0).collect()}
    assert made["a"].boyce > 0.5 and (made["a"].n_presence, made["a"].n_background) == (7, 10)
    assert math.isnan(made["b"].boyce) and (made["b"].n_presence, made["b"].n_background) == (0, 10)
