"""The weather archive: hourly to daily, upsert, rolling features, readiness and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dynamic_score

# Daily rain that triggers, rows of the thermal shock, default rain window.
TRIGGER_MM, SHOCK_ROWS, RAIN_ROWS = 10.0, 10, 15


def daily(hourly: DataFrame, until: Column | None = None, key: str = "meteo_cell_id") -> DataFrame:
    """key, date, precip_mm, soil_temp_c, soil_moist. Hours after ``until`` are left out; a day without
    any rain value is not in the archive, whatever else was measured."""
    rows = hourly if until is None else hourly.where(F.col("time") <= until)
    days = rows.groupBy(key, F.to_date("time").alias("date")).agg(F.sum("precip").alias("precip_mm"), F.avg("soil_temp").alias("soil_temp_c"), F.avg("soil_moist").alias("soil_moist"), F.count("precip").alias("_n"))
    return days.where("_n > 0").drop("_n")


def upsert(archive: DataFrame, batch: DataFrame, order: str = "batch", key: str = "meteo_cell_id") -> DataFrame:
    """The archive with the batch's rows put in by (key, date); the highest ``order`` wins, any batch
    row before the archive's."""
    old = archive.withColumn(order, F.lit(None).cast("long"))
    latest = Window.partitionBy(key, "date").orderBy(F.col(order).desc_nulls_last())
    both = old.unionByName(batch.withColumn(order, F.col(order).cast("long")))
    return both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", order)


def write_upsert(spark, path: str, batch: DataFrame, key: str = "meteo_cell_id", order: str = "batch") -> None:
    """Upserts into an archive in versions; only the dates of the batch are written anew, and readers see all of them or none."""
    from ..sources import archive as store

    store.overwrite_dates(spark, path, lambda old: upsert(old, batch, order, key), batch.select("date").distinct(), key)


def _numbered(days: DataFrame, key: str) -> DataFrame:
    return days.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date"))))


def features(days: DataFrame, profile: DataFrame, key: str = "meteo_cell_id") -> DataFrame:
    """Weather features as of the last archived day, for every species: windows count archived rows,
    not calendar days. One pass makes a sum for each window length that profiles use (a handful)."""
    rows = _numbered(days, key)
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rn")))
    made = rows.groupBy(key).agg(
        F.min_by("date", "rn").alias("last_date"),
        *[F.sum(F.when(F.col("rn") <= n, F.col("precip_mm"))).alias(f"rain_{n}") for n in windows(profile)],
        known("soil_temp_c").alias("temp"), known("soil_moist").alias("moist"),
        F.max(F.when(F.col("rn") <= SHOCK_ROWS, F.col("soil_temp_c"))).alias("recent"),
        (F.min(F.when(F.col("precip_mm") >= TRIGGER_MM, F.col("rn"))) - 1).alias("days_since_trigger"),
    )
    return finished(made, profile, key)


def windows(profile: DataFrame) -> list[int]:
    """The distinct numbers of rows that rain is summed over (a handful); a table of profiles is a few rows on the driver."""
    return sorted({r.n for r in profile.select(F.coalesce("dynamic_triggers.rain_window_days", F.lit(RAIN_ROWS)).alias("n")).collect()})


def finished(made: DataFrame, profile: DataFrame, key: str = "meteo_cell_id") -> DataFrame:
    """Features of every species from a cell's last_date, rain_n for each window, temp, moist, recent and days_since_trigger. Sums of rain
    are first rounded to six decimals, so that a sum halfway between two tenths does not depend on the order of its terms."""
    lengths = [int(c[5:]) for c in made.columns if c.startswith("rain_")]
    sums = F.explode(F.array(*[F.struct(F.lit(n).alias("n_rows"), F.col(f"rain_{n}").alias("rain")) for n in lengths]))
    made = made.withColumn("s", sums).select("*", "s.n_rows", "s.rain")
    shock = F.when(F.col("recent").isNull() | F.col("temp").isNull() | (F.col("temp") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("recent") - F.col("temp")))
    made = made.select(
        key, "n_rows", "last_date", F.month("last_date").alias("month"), F.bround(F.round("rain", 6), 1).alias("cumulative_rain_mm"), F.bround("temp", 1).alias("soil_temp_c"),
        F.bround("moist", 3).alias("soil_moisture"), F.bround(F.round(shock, 6), 1).alias("thermal_shock_c"), "days_since_trigger",
    )
    return made.join(F.broadcast(profile.withColumn("n_rows", F.coalesce("dynamic_triggers.rain_window_days", F.lit(RAIN_ROWS)))), "n_rows").drop("n_rows")


def folded(days: DataFrame, rows: int, key: str = "meteo_cell_id") -> DataFrame:
    """The archive as a row a cell that later days can be merged into: the last ``rows`` rows (dates as days since 1970, newest first,
    and their values), and of the older ones the newest known temperature and moisture, and how many came after the last trigger."""
    numbered = _numbered(days, key).withColumn("old", F.col("rn") > rows)
    tail = F.sort_array(F.collect_list(F.when(~F.col("old"), F.struct(F.unix_date("date").alias("day"), "precip_mm", "soil_temp_c", "soil_moist"))), False)
    known = lambda c: F.min_by(c, F.when(F.col("old") & F.col(c).isNotNull(), F.col("rn")))
    made = numbered.groupBy(key).agg(tail.alias("t"), known("soil_temp_c").alias("older_temp"), known("soil_moist").alias("older_moist"), (F.min(F.when(F.col("old") & (F.col("precip_mm") >= TRIGGER_MM), F.col("rn"))) - rows - 1).cast("int").alias("older_since"))
    part = lambda c: F.transform("t", lambda r: r[c])
    return made.select(key, part("day").alias("day"), part("precip_mm").alias("precip"), part("soil_temp_c").alias("temp"), part("soil_moist").alias("moist"), "older_temp", "older_moist", "older_since")


def history(days: DataFrame, n_rows: int = RAIN_ROWS, key: str = "meteo_cell_id") -> DataFrame:
    """The same features for every archived day, by running windows."""
    w = Window.partitionBy(key).orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    made = days.withColumns({
        "rn": F.row_number().over(w), "rain": F.sum("precip_mm").over(w.rowsBetween(1 - n_rows, 0)), "temp": F.last("soil_temp_c", True).over(past),
        "moist": F.last("soil_moist", True).over(past), "recent": F.max("soil_temp_c").over(w.rowsBetween(1 - SHOCK_ROWS, 0)),
    })
    made = made.withColumn("trigger", F.last(F.when(F.col("precip_mm") >= TRIGGER_MM, F.col("rn")), True).over(past))
    shock = F.when(F.col("recent").isNull() | F.col("temp").isNull() | (F.col("temp") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("recent") - F.col("temp")))
    return made.select(key, "date", F.bround(F.round("rain", 6), 1).alias("cumulative_rain_mm"), F.bround("temp", 1).alias("soil_temp_c"), F.bround("moist", 3).alias("soil_moisture"), F.bround(F.round(shock, 6), 1).alias("thermal_shock_c"), (F.col("rn") - F.col("trigger")).alias("days_since_trigger"))


def phases(days: DataFrame, profile: DataFrame, key: str = "meteo_cell_id") -> DataFrame:
    """key, species, readiness (not rounded) and the fields of the phase."""
    return dynamic_score.with_phase(features(days, profile, key)).select(key, "species", F.col("readiness").alias("readiness_raw"), "phase.*")


def status(days: DataFrame, key: str = "meteo_cell_id") -> DataFrame:
    """Number of archived days and the last one, for each cell."""
    return days.groupBy(key).agg(F.count_distinct("date").alias("n_days"), F.max("date").alias("last_date"))


def gaps(candidates: DataFrame, days: DataFrame, today: Column, key: str = "meteo_cell_id") -> DataFrame:
    """Candidate cells without an archive, or whose archive ends before yesterday."""
    joined = candidates.select(key).distinct().join(status(days, key), key, "left")
    return joined.where(F.col("last_date").isNull() | (F.col("last_date") < F.date_sub(today, 1))).select(key, "last_date")


def backfill_todo(candidates: DataFrame, days: DataFrame, today: Column, backfill: int = 21, key: str = "meteo_cell_id") -> DataFrame:
    """Candidate cells whose archive is not complete: fewer than max(backfill - 3, 14) days, or stale by more than four."""
    done = status(days, key).where((F.col("n_days") >= max(backfill - 3, 14)) & (F.col("last_date") >= F.date_sub(today, 4)))
    return candidates.select(key).distinct().join(done, key, "left_anti")
