"""Weather readiness of species and the phase of their fruiting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import membership as m

# Least charge for a phase, and how many longest lags a phase may be late.
CHARGE, LATE = 0.5, 2.0


def phenology(month: Column, months: Column) -> Column:
    near = F.array_contains(months, F.pmod(month, F.lit(12)) + 1) | F.array_contains(months, F.pmod(month - 2, F.lit(12)) + 1)
    return F.when(month.isNull() | months.isNull() | (F.size(months) == 0), 1.0).when(F.array_contains(months, month), 1.0).when(near, 0.15).otherwise(0.0)


def moisture(x: Column, floor: Column) -> Column:
    return F.when(x.isNull() | floor.isNull(), 1.0).otherwise(m.trapezoid(x, floor - 0.05, floor, F.lit(1.0), F.lit(1.0)))


def _parts() -> dict[str, Column]:
    t = F.col("dynamic_triggers")
    return {
        "phenology": phenology(F.col("month"), F.col("phenology_months")),
        "moisture_gate": moisture(F.col("soil_moisture"), t["moisture_floor"]),
        "rain": m.ramp_up(F.col("cumulative_rain_mm"), F.coalesce(t["cumulative_rain_mm"], F.lit(0.0)), 15.0),
        "soil_temp": m.band(F.col("soil_temp_c"), F.coalesce(t["soil_temp_c"]["min"], F.lit(-50.0)), F.coalesce(t["soil_temp_c"]["max"], F.lit(60.0)), 3.0),
        "shock": F.when(F.col("thermal_shock_c").isNull(), 0.4).otherwise(m.ramp_up(F.col("thermal_shock_c"), F.coalesce(t["thermal_shock_c"], F.lit(0.0)), 3.0)),
        "lag": m.envelope(F.col("days_since_trigger"), t["lag_days"], 6.0),
    }


def with_readiness(features: DataFrame, breakdown: bool = False) -> DataFrame:
    """Adds ``readiness`` (and its parts) and ``charge``, the readiness without the lag factor.
    ``features`` has the weather features and the profile's columns."""
    made = features.withColumns({f"p_{k}": v for k, v in _parts().items()})
    gates = F.col("p_phenology") * F.col("p_moisture_gate")
    graded = lambda *names: m.geometric_mean([(F.col(f"p_{n}"), 1.0) for n in names])
    made = made.withColumns({"readiness": gates * graded("rain", "soil_temp", "shock", "lag"), "charge": gates * graded("rain", "soil_temp", "shock")})
    if breakdown:
        made = made.withColumn("breakdown", F.struct(*[F.col(f"p_{k}").alias(k) for k in _parts()]))
    return made


def with_phase(features: DataFrame, charge: float = CHARGE) -> DataFrame:
    """Adds ``phase``: state (in_fieri, pronto, tardi or null), readiness, charge, dst, eta, days_past."""
    made = with_readiness(features)
    opt = F.col("dynamic_triggers.lag_days.opt")
    first, last, dst = F.get(opt, F.lit(0)), F.get(opt, F.lit(1)), F.col("days_since_trigger")
    open_ = (F.col("p_phenology") != 0) & (F.col("p_moisture_gate") != 0) & (F.col("charge") >= charge) & dst.isNotNull() & opt.isNotNull()
    state = F.when(open_, F.when(dst < first, "in_fieri").when(dst <= last, "pronto").when(dst <= LATE * last, "tardi"))
    made = made.withColumn("state", state)
    return made.withColumn(
        "phase",
        F.struct(
            "state", F.bround("readiness", 3).alias("readiness"), F.bround("charge", 3).alias("charge"), F.when(open_, dst.cast("int")).alias("dst"),
            F.when(F.col("state") == "in_fieri", F.rint(first - dst).cast("int")).alias("eta"),
            F.when(F.col("state") == "tardi", F.rint(dst - last).cast("int")).alias("days_past"),
        ),
    ).drop("state")
