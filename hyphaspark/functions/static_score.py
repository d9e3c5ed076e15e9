"""Static suitability of cells for species: host gate, graded environment, habitat gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.profiles import CONIFER_CLASSES
from . import membership as m

# Default weights of the factors.
WEIGHTS = {"elevation": 1.0, "slope": 0.5, "aspect": 0.8, "soil_ph": 0.8, "drainage": 0.5}


def host_gate() -> Column:
    """Weighted match of the cell's host map. Unknown hosts (null) do not count against a cell, an
    empty map means that no host is there; dead crowns lower conifer hosts."""
    alive = lambda k: F.when(k.isin(CONIFER_CLASSES), F.coalesce("canopy_alive", F.lit(1.0))).otherwise(1.0)
    total = F.aggregate(F.map_entries("host"), F.lit(0.0), lambda acc, e: acc + e["value"] * (F.coalesce(F.try_element_at("host_genera", e["key"]), F.lit(0.0)) * alive(e["key"])))
    return F.when(F.col("trophic_mode") != "mycorrhizal", 1.0).when(F.col("host").isNull(), 1.0).when(F.size("host") == 0, 0.0).otherwise(m.clamp01(total))


def factors() -> dict[str, Column]:
    env = F.col("static_envelope")
    return {
        "elevation": m.envelope(F.col("elevation_m"), env["elevation_m"], 200.0),
        "slope": m.envelope(F.col("slope_deg"), env["slope_deg"], 10.0),
        "aspect": m.categorical("aspect", env["aspect"], F.col("aspect")),
        "soil_ph": m.categorical("soil_ph", env["soil_ph"], F.col("soil_ph")),
        "drainage": m.categorical("drainage", env["drainage"], F.col("drainage")),
    }


def habitat_gate() -> Column:
    return F.when(F.col("habitat") == "grassland", F.coalesce("grassland_fraction", F.lit(1.0))).otherwise(F.coalesce("forest_fraction", F.lit(1.0)))


_FEATURES = {"host": "map<string,double>", "canopy_alive": "double", "elevation_m": "double", "slope_deg": "double", "aspect": "string", "soil_ph": "string", "drainage": "string", "forest_fraction": "double", "grassland_fraction": "double"}


def score_cells(cells: DataFrame, profile: DataFrame, weights: dict[str, float] | None = None, breakdown: bool = False) -> DataFrame:
    """Every cell for every species: the cells' columns, species, score and, if asked for, its parts.
    The profile table is a handful of rows and is broadcast; missing feature columns count as unknown.
    A ``host_class`` column stands for a host map with that class alone."""
    for name, kind in _FEATURES.items():
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(None).cast(kind))
    if "host_class" in cells.columns:
        cells = cells.withColumn("host", F.coalesce("host", F.when(F.col("host_class").isNotNull(), F.create_map(F.col("host_class"), F.lit(1.0)))))
    weights = weights or WEIGHTS
    every = cells.crossJoin(F.broadcast(profile))
    parts = factors()
    every = every.withColumns({"f_host": host_gate(), "f_gate": habitat_gate()} | {f"f_{k}": v for k, v in parts.items()})
    graded = m.geometric_mean([(F.col(f"f_{k}"), weights.get(k, 1.0)) for k in parts])
    scored = every.withColumn("score", F.col("f_host") * graded * F.col("f_gate"))
    out = [*cells.columns, "species", "score"]
    if breakdown:
        scored = scored.withColumn("breakdown", F.struct(F.col("f_host").alias("host"), F.col("f_gate").alias("habitat_gate"), *[F.col(f"f_{k}").alias(k) for k in parts]))
        out.append("breakdown")
    return scored.select(*out)
