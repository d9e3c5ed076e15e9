"""Field observations: cleaning, cell keys, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid

# What an observation may hold.
FIELDS = ["ts_submit", "user_id", "x", "y", "species", "target_species", "is_blank", "phase", "old_reason", "abundance", "weight_g", "effort_min", "photo_file_id", "id_verified", "static_cell_id", "meteo_cell_id"]
PHASES, OLD_REASONS, ABUNDANCES = ["primordi", "buono", "vecchio"], ["senescente", "abortito"], ["uno", "pochi", "molti"]


def clean(raw: DataFrame) -> DataFrame:
    """Whitelisted columns plus id (of the row's content, where there is none) and ``error``: numbers with a decimal comma are read, flags get their
    defaults, values outside the domains are errors. Rows with an error belong in quarantine."""
    for name, kind in (("target_species", "string"), ("old_reason", "string"), ("abundance", "string"), ("effort_min", "int"), ("id_verified", "int"), ("static_cell_id", "string"), ("meteo_cell_id", "string"), ("photo_file_id", "string")):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    if "id" not in raw.columns:
        raw = raw.withColumn("id", F.xxhash64("ts_submit", "user_id", "x", "y", "species", "phase", "weight_text"))
    weight = F.regexp_replace("weight_text", ",", ".").try_cast("double")
    bad = lambda c, allowed: F.when(F.col(c).isNotNull() & ~F.col(c).isin(allowed), c)
    error = F.array_join(F.array_compact(F.array(F.when(F.col("weight_text").isNotNull() & weight.isNull(), "weight_text"), bad("phase", PHASES), bad("old_reason", OLD_REASONS), bad("abundance", ABUNDANCES))), ",")
    made = raw.withColumns({"weight_g": weight, "is_blank": F.coalesce("is_blank", F.lit(0)), "id_verified": F.coalesce("id_verified", F.lit(1)), "error": F.when(error != "", error)})
    return made.select("id", *FIELDS, "error")


def assign_cells(rows: DataFrame) -> DataFrame:
    """Rows with coordinates get both cell keys anew if either is missing."""
    todo = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("static_cell_id").isNull() | F.col("meteo_cell_id").isNull())
    s, w = grid.static_cell(F.col("x"), F.col("y")), grid.weather_cell(F.col("x"), F.col("y"))
    return rows.withColumns({"static_cell_id": F.when(todo, s).otherwise(F.col("static_cell_id")), "meteo_cell_id": F.when(todo, w).otherwise(F.col("meteo_cell_id"))})


def pins(rows: DataFrame) -> DataFrame:
    """Observations with coordinates as features, newest first when collected in order of ``ts``."""
    photo = F.col("photo_file_id").isNotNull() & (F.col("photo_file_id") != "")
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("id", "species", "phase", "weight_g", "abundance", "is_blank", F.col("ts_submit").alias("ts"), photo.alias("photo"), "x", "y").orderBy(F.desc("ts"), "id")
