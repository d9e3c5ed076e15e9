import math

import pytest
from pyspark.sql import functions as F

from hyphaspark.functions import dynamic_score, membership, static_score
from hyphaspark.sources import profiles

CELL = {"host_class": "querceto", "elevation_m": 400.0, "slope_deg": 15.0, "aspect": "warm", "soil_ph": "acidic", "drainage": "well_drained"}
KINDS = {"host_class": "string", "host": "map<string,double>", "elevation_m": "double", "slope_deg": "double", "aspect": "string", "soil_ph": "string", "drainage": "string", "canopy_alive": "double", "forest_fraction": "double", "grassland_fraction": "double"}


def score(spark, species="boletus_aereus", profile=None, **changes):
    cell = CELL | changes
    rows = spark.createDataFrame([tuple(cell.values())], ", ".join(f"{k} {KINDS[k]}" for k in cell))
    table = profile if profile is not None else profiles.profiles(spark, only=[species])
    return static_score.score_cells(rows, table).first().score


def test_profiles_are_valid(spark):
    table = profiles.profiles(spark).withColumn("errors", profiles.errors())
    assert table.count() == 6 and table.where(F.size("errors") > 0).count() == 0
    bad = profiles.profiles(spark, [{"id": "x", "trophic_mode": "odd", "habitat": "sea", "host_genera": {"oak": 1}, "phenology_months": [0]}, {"id": "y", "host_genera": {}}])
    found = {r.species: r.errors for r in bad.select("species", profiles.errors().alias("errors")).collect()}
    assert len(found["x"]) == 4 and found["y"] == ["mycorrhizal without hosts"]
    names = [r.n for r in profiles.profiles(spark).orderBy("common_name").select(profiles.scientific_name(F.col("species")).alias("n")).collect()]
    assert names[0] == "Boletus aestivalis" and len(names) == 6
    assert profiles.crosswalk(spark).count() == 20


def test_profile_folder(spark, tmp_path):
    (tmp_path / "a_one.yaml").write_text("species:\n  id: a_one\n  host_genera: {querceto: 1.0}\n  phenology_months: [5]\n")
    (tmp_path / "b.yaml").write_text("species: [broken\n")
    (tmp_path / "c.yaml").write_text("")
    (tmp_path / "z.yaml").write_text("species:\n  id: a_one\n  common_name: later\n  host_genera: {querceto: 0.5}\n")
    rows = {r.file: r for r in profiles.profiles_from_folder(spark, str(tmp_path)).withColumn("errors", profiles.submission_errors()).collect()}
    assert set(rows) == {"b.yaml", "z.yaml"} and rows["z.yaml"].common_name == "later"
    assert rows["b.yaml"].parse_error and rows["z.yaml"].errors == ["id differs from file name"]


def test_static_rules(spark):
    assert score(spark) > 0.6
    assert score(spark, host_class="faggeta") == 0
    assert score(spark, host_class=None) > 0.5
    assert score(spark, host_class=None, host={}) == 0
    assert score(spark, elevation_m=900.0) < score(spark)
    edulis = dict(species="boletus_edulis", host_class="pecceta", elevation_m=1200.0, aspect="cool")
    assert score(spark, canopy_alive=0.1, **edulis) < score(spark, canopy_alive=1.0, **edulis)
    assert math.isclose(score(spark, forest_fraction=0.5), score(spark, forest_fraction=1.0) / 2)
    meadow = profiles.profiles(spark, [{"id": "m", "trophic_mode": "saprotrophic", "habitat": "grassland", "static_envelope": {"elevation_m": {"opt": [0, 1000]}}}])
    assert score(spark, profile=meadow, grassland_fraction=0.0) == 0 < score(spark, profile=meadow, grassland_fraction=0.9)


def ready(spark, **changes):
    feat = {"month": 8, "soil_moisture": 0.30, "cumulative_rain_mm": 60.0, "soil_temp_c": 17.0, "thermal_shock_c": 6.0, "days_since_trigger": 14} | changes
    rows = spark.createDataFrame([tuple(feat.values())], "month int, soil_moisture double, cumulative_rain_mm double, soil_temp_c double, thermal_shock_c double, days_since_trigger int")
    return dynamic_score.with_phase(rows.crossJoin(profiles.profiles(spark, only=["boletus_aereus"]))).first()


def test_readiness_rules(spark):
    assert ready(spark).readiness > 0.5 and ready(spark).phase.state == "pronto"
    assert ready(spark, month=1).readiness == 0 and ready(spark, soil_moisture=0.05).readiness == 0
    early = ready(spark, days_since_trigger=4).phase
    assert (early.state, early.eta) == ("in_fieri", 6)
    late = ready(spark, days_since_trigger=30).phase
    assert (late.state, late.days_past) == ("tardi", 12)
    assert ready(spark, days_since_trigger=40).phase.state is None and ready(spark, month=5).phase.state is None
    assert ready(spark, days_since_trigger=None).phase.dst is None


@pytest.mark.parametrize("x,want", [(0.0, 0.0), (5.0, 0.0), (7.5, 0.5), (10.0, 1.0), (20.0, 1.0), (25.0, 0.5), (30.0, 0.0), (31.0, 0.0)])
def test_trapezoid(spark, x, want):
    assert spark.range(1).select(membership.trapezoid(F.lit(x), F.lit(5.0), F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("v")).first().v == want


def test_null_rules(spark):
    none, one = F.lit(None).cast("double"), F.lit(1.0)
    v = spark.range(1).select(membership.band(none, one, one, 1.0).alias("band"), membership.ramp_up(none, one, 1.0).alias("ramp"), membership.ramp_up(F.lit(0.5), one, 1.0).alias("half"), membership.categorical("aspect", F.lit("warm"), F.lit(None).cast("string")).alias("cat"), membership.categorical("aspect", F.lit("odd"), F.lit("warm")).alias("odd")).first()
    assert tuple(v) == (0.5, 0.0, 0.5, 0.5, 0.0)


def test_boyce_counts_points_first(spark):
    """Points of one cell count as one row with their number, and validation gives what points one by one give."""
    import random

    from hyphaspark.operators import evaluate

    rng = random.Random(5)
    maps = spark.createDataFrame([(s, i, j, rng.random()) for s in ("a", "b") for i in range(8) for j in range(8)], "species string, i int, j int, score double")
    pres = [(rng.choice("ab"), rng.uniform(-5, 85), rng.uniform(-5, 85)) for _ in range(200)]
    bg = [(rng.uniform(-5, 85), rng.uniform(-5, 85)) for _ in range(600)]
    of = {(r.species, r.i, r.j): r.score for r in maps.collect()}
    cell = lambda x, y: (int((80 - y) // 10), int(x // 10))
    points = [(s, "pres", of[s, *cell(x, y)]) for s, x, y in pres if (s, *cell(x, y)) in of] + [(s, "bg", of[s, *cell(x, y)]) for x, y in bg for s in "ab" if (s, *cell(x, y)) in of]
    made = evaluate.validate(spark.createDataFrame(pres, "species string, x double, y double"), spark.createDataFrame(bg, "x double, y double"), maps, (0.0, 80.0), 10.0)
    want = evaluate.boyce(spark.createDataFrame(points, "species string, kind string, score double"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [i#" in plan  # points of a cell are counted before the join
