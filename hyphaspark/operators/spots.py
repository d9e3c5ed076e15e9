"""Candidates, top cells, and top spots: static suitability combined with weather readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid

# Candidate threshold, cells of a map's top list, spacing and number of spots.
THRESHOLD, TOP_CELLS, SPACING, SPOTS = 0.4, 300, 1500.0, 50


def above(threshold: float = THRESHOLD, score: str = "score") -> Column:
    """Maps hold 32-bit scores, and the threshold is compared as one: 0.4 itself is not above 0.4."""
    return F.col(score).cast("float") > F.lit(threshold).cast("float")


def map_stats(scored: DataFrame) -> DataFrame:
    """species, max_score, n_candidates, n_scored, n_top."""
    stats = scored.groupBy("species").agg(F.max("score").alias("max_score"), F.count_if(above()).alias("n_candidates"), F.count_if(F.col("score") > 0).alias("n_scored"))
    return stats.withColumn("n_top", F.least(F.lit(TOP_CELLS).cast("long"), F.col("n_candidates")))


def top_cells(scored: DataFrame, tie: list[str], k: int = TOP_CELLS) -> DataFrame:
    """The k best candidates of each species, ties in the order of ``tie``."""
    order = Window.partitionBy("species").orderBy(F.desc("score"), *tie)
    return scored.where(above()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_cells(scored: DataFrame, max_cells: int | None = None) -> DataFrame:
    """Weather cells with a candidate of any species; with a cap, those with the best candidates."""
    cells = scored.where(above()).select(grid.weather_cell(F.col("x"), F.col("y")).alias("meteo_cell_id"), "score")
    if max_cells is None:
        return cells.select("meteo_cell_id").distinct()
    return cells.groupBy("meteo_cell_id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "meteo_cell_id").limit(max_cells).select("meteo_cell_id")


def phases_by_cell(scored: DataFrame, phases: DataFrame) -> DataFrame:
    """Phases of the weather cells that hold a candidate of the species; cells without an archive or a phase drop out."""
    candidates = scored.where(above()).select("species", grid.weather_cell(F.col("x"), F.col("y")).alias("meteo_cell_id")).distinct()
    return candidates.join(phases.where("state IS NOT NULL"), ["species", "meteo_cell_id"])


def top_spots(scored: DataFrame, phases: DataFrame | None, mode: str = "both", k: int = SPOTS, spacing: float = SPACING) -> DataFrame:
    """The k best spots of each species, one per block of ``spacing`` metres: species, rank, score, suitability,
    readiness, x, y. ``static`` scores by suitability, ``dynamic`` by readiness, ``both`` (and any
    other mode) by their product; weather cells without an archive have readiness 0.

    Readiness has a row per species and weather cell, far fewer than map cells, so it is joined by its
    key and Spark may broadcast it if it is small enough."""
    mode = mode if mode in ("static", "dynamic") else "both"
    rows = scored.where(above()).select("species", F.col("score").alias("suitability"), "x", "y", grid.weather_cell(F.col("x"), F.col("y")).alias("meteo_cell_id"))
    if mode == "static":
        rows = rows.withColumn("readiness", F.lit(1.0))
    else:
        ready = phases.select("species", "meteo_cell_id", F.col("readiness_raw").alias("readiness"))
        rows = rows.join(ready, ["species", "meteo_cell_id"], "left").withColumn("readiness", F.coalesce("readiness", F.lit(0.0)))
    score = {"static": F.col("suitability"), "dynamic": F.col("readiness"), "both": F.col("suitability") * F.col("readiness")}[mode]
    item = F.struct(F.col("s").alias("score"), "suitability", "readiness", "x", "y")
    best = rows.withColumn("s", score).where("s > 0").groupBy("species", F.floor(F.col("x") / spacing).alias("bx"), F.floor(F.col("y") / spacing).alias("by")).agg(F.max(item).alias("b"))
    order = Window.partitionBy("species").orderBy(F.desc("b"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("species", "rank", "b.*")
