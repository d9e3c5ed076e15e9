"""The weather archive as a stream: daily aggregates with late data, upserts, and cells that are watched by their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dynamic_score
from ..operators import observations as obs
from ..operators import weather
from ..sources import archive
from . import cell_watch

SCHEMA = "event_id long, meteo_cell_id string, time timestamp_ntz, precip double, soil_temp double, soil_moist double"
CHANGES = "meteo_cell_id string, date date, precip_mm double, soil_temp_c double, soil_moist double, now timestamp, batch int"
ARCHIVE = "meteo_cell_id string, date date, precip_mm double, soil_temp_c double, soil_moist double"


def daily_stream(hours: DataFrame, lateness: str = "3 days", ids: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Tumbling days per cell. Repeats of an hour (same ids) within the watermark count once; hours later
    than ``lateness`` are for a batch upsert. With ``digits`` values are rounded, so that sums made in another order agree. Event times must be instants for a watermark: run with the
    session time zone UTC, in which local hours map to them one to one."""
    once = hours.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", lateness).dropDuplicatesWithinWatermark(ids or ["event_id"])
    days = once.groupBy("meteo_cell_id", F.window("time", "1 day").alias("w")).agg(F.sum("precip").alias("precip_mm"), F.avg("soil_temp").alias("soil_temp_c"), F.avg("soil_moist").alias("soil_moist"), F.count("precip").alias("n"))
    value = lambda c: F.col(c) if digits is None else F.round(c, digits).alias(c)
    return days.where("n > 0").select("meteo_cell_id", F.to_date("w.start").alias("date"), *[value(c) for c in ("precip_mm", "soil_temp_c", "soil_moist")])


def run_archive(hours: DataFrame, path: str, checkpoint: str, available_now: bool = True, digits: int | None = None) -> StreamingQuery:
    """Keeps the archive at ``path`` up to date and logs the days that a batch changes, with the archive's last date as the
    time that has come, for ``run_watch``. A batch that is run again changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # the dates, the archive and the log read it, and the stream's states are gone through once
        try:
            weather.write_upsert(spark, path, batch.withColumn("batch", F.lit(number)))
            last = max(archive.current(spark, path)[1], default=None)
            _logged(batch.withColumn("now", F.lit(last).cast("timestamp")), f"{path}/changes", number)
        finally:
            batch.unpersist()

    writer = daily_stream(hours, digits=digits).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _logged(rows: DataFrame, path: str, number: int) -> None:
    """A folder for a batch; the same batch again replaces its own rows."""
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def run_watch(spark: SparkSession, path: str, events: str, checkpoint: str, profile: DataFrame, watched: DataFrame | None = None, before: DataFrame | None = None, files_per_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Follows the changes that ``run_archive`` logs and writes what becomes of the cells, batch by batch, to ``events``: features
    of the changed ones, and alerts of those that fall behind (see ``cell_watch``). Neither reads the archive. ``watched`` cells
    need not be in it; ``before`` holds days from before the log began."""
    cell_watch.configure(spark)
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/changes")
    made = cell_watch.watch(changes, profile, watched, before)
    writer = made.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: _logged(batch, events, number))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def phases(events: DataFrame, profile: DataFrame) -> DataFrame:
    """The phases of all cells from the features that ``run_watch`` wrote last."""
    rows = cell_watch.features(cell_watch.latest(events, ["features"]), profile)
    return dynamic_score.with_phase(rows).select("meteo_cell_id", "species", F.col("readiness").alias("readiness_raw"), "phase.*")


def capture_observations(raw: DataFrame, path: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Appends clean observations, with their cells, to ``path`` and the others to ``quarantine``; a
    batch that is run again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        rows = obs.assign_cells(obs.clean(batch)).withColumn("batch", F.lit(number))
        for part, to in ((rows.where("error IS NULL"), path), (rows.where("error IS NOT NULL"), quarantine)):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_hours(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
