"""The suitability table: one partition a species, as maps hold it (32-bit scores, 0 for nodata)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders
from .profiles import scientific_name


def write(scored: DataFrame, path: str) -> None:
    """Writes the species in ``scored`` and leaves the others as they are. Cells come in ``x, y`` order within a
    species' files, so that a box of cells reads few row groups."""
    table = scored.withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)).cast("float"))
    table = table.repartitionByRange("species", "x", "y").sortWithinPartitions("species", "x", "y")
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("species").parquet(path)


def read(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """The table, or the partitions of some species; an error where there is none yet."""
    if not folders.exists(spark, path):
        raise FileNotFoundError(f"no suitability table at {path}: write one first")
    table = spark.read.parquet(path)
    return table if only is None else table.where(F.col("species").isin(only))


def species(spark: SparkSession, path: str) -> DataFrame:
    """species, name: the species there are maps for, in order; found from the partitions alone."""
    return read(spark, path).select("species").distinct().withColumn("name", scientific_name(F.col("species"))).orderBy("species")
