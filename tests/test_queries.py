"""Registered queries against DuckDB on the smallest tables, and the driver's contract."""

import glob
import os
from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hyphaspark.plans import oracles, queries

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(oracles.ORACLE_SQL))
def test_like_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    found = duck.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) == set(oracles.ORACLE_SQL)
    assert entry.entry(spark).count() > 0


def shifted(spark, duck, path, table, **keys):
    """The smallest table with its keys moved, for both engines."""
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    df.selectExpr(*[f"{c} + {keys[c]}L AS {c}" if c in keys else c for c in df.columns]).write.parquet(f"{path}/{table}.parquet")
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'").fetchall()
    return con


def same(spark, con, path, name):
    df = queries.QUERIES[name](spark, str(path))
    found = con.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = sorted(([tuple(norm(r[c]) for c in names) for r in df.collect()]), key=str)
    assert got == sorted((tuple(map(norm, r)) for r in found.fetchall()), key=str)
    return got


@pytest.mark.parametrize("name", ["grid_cells", "tile_manifest"])
def test_far_grids_like_sql(spark, duck, tmp_path, name):
    """Cells beyond 10,000 km and 180 degrees, where many customers lead: the SQL has no bounds of its own."""
    con = shifted(spark, duck, tmp_path, "orders", o_custkey=8 * 40 * (2270 if name == "grid_cells" else 2800))
    got = same(spark, con, tmp_path, name)
    assert max(r[1] for r in got) >= 10_000 if name == "grid_cells" else max(r[2] for r in got) >= 180


@pytest.mark.parametrize("name", ["meteo_features", "meteo_history", "stream_features"])
def test_sums_halfway_like_sql(spark, duck, tmp_path, name):
    """Rain of days that sums up to halfway between two tenths, in doubles just below or above it by the order of the terms."""
    rows, at = [], 0
    for user in range(40):
        for day in range(14):
            for value in ((30 * (0.1 + day * 0.7)), 1.5 if day == 13 else 3.0 * user):
                rows.append((at, f"2024-01-{day + 1:02d} 0{at % 7}:00:00", user, "view", value))
                at += 1
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'").fetchall()
    got = same(spark, con, tmp_path, name)
    if name == "meteo_history":  # a cell's last sum, exactly: thousandths, halves to even
        sums = [sum(100 + 700 * d + (50 if d == 13 else 100 * user) for d in range(14)) for user in range(40)]
        want = [float(Decimal(n).scaleb(-3).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for n in sums]
        assert sorted({r[0]: r[2] for r in sorted(got, key=lambda r: r[:2])}.values()) == sorted(want)


def test_layers_are_not_broadcast(spark):
    """Pixels and bins of polygons look as small as the tables that they are made of: only the profiles and the number of tiles go to all executors."""
    plan = queries.suitability_at(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") == 3
