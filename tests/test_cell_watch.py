"""State of weather cells that days are merged into, alerts by timers, and the archive in versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from hyphaspark.operators import weather
from hyphaspark.sources import archive, profiles
from hyphaspark.streaming import cell_watch, weather_stream

DAYS = "meteo_cell_id string, date date, precip_mm double, soil_temp_c double, soil_moist double"
START = dt.date(2024, 5, 1)


def table(spark, rows):
    return spark.createDataFrame([(c, START + dt.timedelta(days=d), *v) for (c, d), v in sorted(rows.items())], DAYS)


def some(rng):
    return (float(rng.choice([0, 0, 1, 2, 5, 11, 30])), rng.choice([None, float(rng.randint(0, 25))]), rng.choice([None, rng.randint(10, 40) / 100]))


def brute(rows, windows):
    """Features of one cell from all its rows."""
    order = sorted(rows, reverse=True)
    values = [rows[d] for d in order]
    known = lambda k: next((v[k] for v in values if v[k] is not None), None)
    recent = [v[1] for v in values[: weather.SHOCK_ROWS] if v[1] is not None]
    return {"last_day": order[0], **{f"rain_{n}": sum(v[0] for v in values[:n]) for n in windows}, "temp": known(1), "moist": known(2), "recent": max(recent, default=None), "days_since_trigger": next((k for k, v in enumerate(values) if v[0] >= 10), None)}


def test_buffer_like_whole_history():
    rng = random.Random(1)
    for rows in (10, 15, 32):
        for _ in range(200):
            b, all_rows = cell_watch.Buffer(), {}
            for day in range(rng.randint(1, 70)):
                for d in {day, day - rng.randint(0, 4)} - ({day} if rng.random() < 0.2 else set()):  # gaps, late days, other values
                    if d >= 0:
                        all_rows[d] = some(rng)
                        assert b.put(d, *all_rows[d], rows=rows)
                if all_rows:
                    assert b.features([3, 10]) == brute(all_rows, [3, 10])
            if len(b.day) == rows:
                assert not b.put(min(b.day) - 1, 1.0, None, None, rows=rows)


def test_folded_like_put(spark):
    rng = random.Random(2)
    rows = {(f"m{c}", d): some(rng) for c in range(12) for d in range(c * 6 + 1) if rng.random() < 0.9 or d == 0}
    made = {r.meteo_cell_id: r for r in weather.folded(table(spark, rows), 20).collect()}
    zero = START.toordinal() - dt.date(1970, 1, 1).toordinal()
    for c in {c for c, _ in rows}:
        b = cell_watch.Buffer()
        for d in sorted(d for x, d in rows if x == c):
            b.put(d + zero, *rows[c, d], rows=20)
        assert {k: made[c][k] for k in cell_watch.FIELDS} == {k: getattr(b, k) for k in cell_watch.FIELDS}


def test_watch_after_every_batch(spark, tmp_path):
    """Late, repeated and corrected days, in many batches: features, trigger ages and alerts are always those of the whole archive."""
    rng = random.Random(3)
    profile, cells = profiles.profiles(spark), [f"m2200_{c}_1" for c in range(7)]
    before = {(c, d): some(rng) for c in cells[:3] for d in range(-50, 0)}
    known, batches = dict(before), []
    for n in range(6):
        changed = {}
        for c in cells[: 5 if n < 3 else 2] if n != 4 else []:  # some cells fall behind; one never has a day; one batch is empty but for a late day
            for d in {n * 2, n * 2 + 1, max(0, n * 2 - rng.randint(0, 3))}:
                changed[c, d] = some(rng)
        if n == 4:
            changed[cells[0], 5] = some(rng)
        if n == 5:
            changed[cells[3], 11] = some(rng)  # fresh again
        known |= changed
        batches.append((changed, dict(known)))
    path, now = str(tmp_path / "archive"), 0
    run = lambda: weather_stream.run_watch(spark, path, str(tmp_path / "events"), str(tmp_path / "cp"), profile, spark.createDataFrame([(c,) for c in cells], "meteo_cell_id string"), table(spark, before)).awaitTermination()
    for n, (changed, whole) in enumerate(batches):
        now = max(now, *(d for _, d in changed))
        rows = table(spark, changed).withColumn("now", F.lit(str(START + dt.timedelta(days=now))).cast("timestamp"))
        weather_stream._logged(rows, f"{path}/changes", n)
        run()  # each run goes on from the checkpoint
        events = spark.read.parquet(str(tmp_path / "events"))
        days, today = table(spark, whole), F.lit(str(START + dt.timedelta(days=now))).cast("date")
        alerts = {tuple(r) for r in cell_watch.stale(events).collect()}
        assert alerts == {tuple(r) for r in weather.gaps(spark.createDataFrame([(c,) for c in cells], "meteo_cell_id string"), days, today).collect()}, n
        got = {(r.meteo_cell_id, r.species): r for r in cell_watch.features(cell_watch.latest(events, ["features"]), profile).collect()}
        want = {(r.meteo_cell_id, r.species): r for r in weather.features(days, profile).collect()}
        seen = {c for _, upto in batches[: n + 1] for c, d in upto if d >= 0}
        for (cell, species), r in want.items():
            if cell in seen:
                for c in ("last_date", "cumulative_rain_mm", "soil_temp_c", "soil_moisture", "thermal_shock_c", "days_since_trigger"):
                    assert got[cell, species][c] == r[c], (n, cell, c)
    reports = events.where("kind = 'stale'").groupBy("meteo_cell_id", "last_day").count()
    assert reports.where("count > 1").count() == 0  # once for each cell that falls behind
    assert events.where("kind = 'fresh'").count() >= 1 and events.where("kind = 'late'").count() == 0


def test_days_older_than_the_buffer(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = {("m", d): (1.0, None, None) for d in range(40)} | {("m", -30): (50.0, 1.0, None)}
    order = sorted(rows.items(), key=lambda x: x[0][1] if x[0][1] >= 0 else 99)
    for n, part in enumerate((order[:40], order[40:])):
        weather_stream._logged(table(spark, dict(part)).withColumn("now", F.lit("2024-07-01").cast("timestamp")), f"{path}/changes", n)
        weather_stream.run_watch(spark, path, str(tmp_path / "events"), str(tmp_path / "cp"), profiles.profiles(spark)).awaitTermination()
    late = spark.read.parquet(str(tmp_path / "events")).where("kind = 'late'").collect()
    assert [(r.meteo_cell_id, dt.date(1970, 1, 1) + dt.timedelta(days=r.last_day)) for r in late] == [("m", START - dt.timedelta(days=30))]
    with pytest.raises(ValueError):
        cell_watch.CellWatch([50])


def rows_of(df):
    return {(r.meteo_cell_id, r.date): (r.precip_mm, r.soil_temp_c, r.soil_moist) for r in df.collect()}


def test_archive_survives_a_broken_write(spark, tmp_path, monkeypatch):
    """A job that dies between write and switch leaves the old archive whole; run again, it replaces all its dates at once."""
    path = str(tmp_path / "archive")
    first = table(spark, {(c, d): (1.0, 2.0, 3.0) for c in "ab" for d in range(4)})
    weather.write_upsert(spark, path, first.withColumn("batch", F.lit(1)))
    old = rows_of(archive.read(spark, path, DAYS))
    assert len(old) == 8
    second = table(spark, {("a", d): (9.0, None, None) for d in (2, 3, 4)}).withColumn("batch", F.lit(2))
    whole = archive.switch

    def dies(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(archive, "switch", dies)
    with pytest.raises(KeyboardInterrupt):
        weather.write_upsert(spark, path, second)
    assert rows_of(archive.read(spark, path, DAYS)) == old
    monkeypatch.setattr(archive, "switch", whole)
    planned = archive.read(spark, path, DAYS)  # a reader that has planned before the switch
    weather.write_upsert(spark, path, second)
    want = old | {("a", START + dt.timedelta(days=d)): (9.0, None, None) for d in (2, 3, 4)}
    assert rows_of(archive.read(spark, path, DAYS)) == want and rows_of(planned) == old
    for n in range(3, 7):
        weather.write_upsert(spark, path, table(spark, {("b", 0): (float(n), None, None)}).withColumn("batch", F.lit(n)))
    version, folders = archive.current(spark, path)
    assert version == 6 and len({f for f in folders.values()}) == 3
    assert len(archive._names(spark, f"{path}/data")) == 4 and len(archive._names(spark, f"{path}/manifests")) == 2  # the broken write's folder is gone
    files = archive.read(spark, path, DAYS, [str(START)]).inputFiles()
    assert files and all("day=2024-05-01" in f for f in files)


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "archive")
    weather.write_upsert(spark, path, table(spark, {("a", 0): (1.0, None, None)}).withColumn("batch", F.lit(1)))
    version, folders = archive.current(spark, path)
    with pytest.raises(RuntimeError):
        archive.switch(spark, path, version, {})
    assert archive.current(spark, path) == (version, folders) and json.dumps(folders)
    assert archive.read(spark, str(tmp_path / "none"), DAYS).count() == 0


class _Handle:
    """Counts what a processor asks of the state server."""

    def __init__(self):
        self.state, self.timers, self.asked = None, set(), []

    def __getattr__(self, name):
        def ask(*args):
            self.asked.append(name)
            if name == "get":
                return self.state
            if name == "update":
                self.state = args[0]
            if name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.remove)(args[0])
            return self if name == "getValueState" else None

        return ask


def test_a_cell_asks_the_state_server_little():
    """Its timer is known from its state: only one that moves is told, and none is listed."""
    import pandas as pd

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    handle, processor = _Handle(), cell_watch.CellWatch([15])
    processor.init(handle)
    seen = []
    for day in (100, 99, 101, 101):
        handle.asked.clear()
        rows = pd.DataFrame({"day": [day], "batch": [0], "precip_mm": [1.0], "soil_temp_c": [None], "soil_moist": [0.2]})
        list(processor.handleInputRows(("c",), iter([rows]), Now()))
        seen.append(list(handle.asked))
    assert seen == [["get", "registerTimer", "update"], ["get", "update"], ["get", "deleteTimer", "registerTimer", "update"], ["get", "update"]]
    assert handle.timers == {cell_watch.due(101)}


def test_a_batch_is_made_once(spark, tmp_path, monkeypatch):
    """The upsert and the log read the same kept rows, which are released."""
    kept, upsert = [], weather_stream.weather.write_upsert
    monkeypatch.setattr(weather_stream.weather, "write_upsert", lambda s, p, batch, *a: (kept.append("InMemory" in batch._jdf.queryExecution().withCachedData().toString()), upsert(s, p, batch, *a)))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    spark.sql("SELECT 1L AS event_id, 'c' AS meteo_cell_id, timestamp_ntz'2024-01-01 05:00:00' AS time, 1.0D AS precip, 2.0D AS soil_temp, 0.1D AS soil_moist").write.parquet(f"{tmp_path}/in")
    weather_stream.run_archive(spark.readStream.schema(weather_stream.SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/archive", f"{tmp_path}/checkpoint").awaitTermination()
    assert kept and all(kept) and spark.sparkContext._jsc.getPersistentRDDs().size() == before
