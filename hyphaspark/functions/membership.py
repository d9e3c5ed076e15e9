"""Fuzzy membership functions as Column expressions, all with values in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Soft matches of categories, preference -> measured -> membership.
MATCHES = {
    "aspect": {"warm": {"warm": 1.0, "neutral": 0.5, "cool": 0.1}, "cool": {"cool": 1.0, "neutral": 0.5, "warm": 0.1}, "neutral": {"neutral": 1.0, "warm": 0.6, "cool": 0.6}},
    "soil_ph": {"acidic": {"acidic": 1.0, "neutral": 0.6, "calcareous": 0.15}, "calcareous": {"calcareous": 1.0, "neutral": 0.6, "acidic": 0.15}, "neutral": {"neutral": 1.0, "acidic": 0.6, "calcareous": 0.6}, "tolerant": {"acidic": 0.9, "neutral": 0.9, "calcareous": 0.8}},
    "drainage": {"well_drained": {"well_drained": 1.0, "moist": 0.6, "dry": 0.5, "waterlogged": 0.1}, "moist": {"moist": 1.0, "well_drained": 0.6, "waterlogged": 0.3, "dry": 0.2}},
}
FLOOR = 1e-6


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def trapezoid(x: Column, low: Column, rise: Column, fall: Column, high: Column) -> Column:
    """0 up to ``low``, 1 from ``rise`` to ``fall``, 0 from ``high`` on, linear in between. Where the
    two bounds of a side are equal, that side stays open."""
    return (
        F.when(x <= low, F.when(low == rise, 1.0).otherwise(0.0))
        .when(x < rise, clamp01(F.try_divide(x - low, rise - low)))
        .when(x <= fall, 1.0)
        .when(x < high, clamp01(F.try_divide(high - x, high - fall)))
        .otherwise(F.when(high == fall, 1.0).otherwise(0.0))
    )


def envelope(x: Column, env: Column, margin: float) -> Column:
    """Trapezoid of a {min, opt, max} range; a missing bound lies ``margin`` outside the optimum (not
    below 0). Unmeasured values and ranges without an optimum do not count against a cell."""
    opt = env["opt"]
    low, high = F.get(opt, F.lit(0)), F.get(opt, F.lit(1))
    usable = x.isNotNull() & opt.isNotNull() & (F.size(opt) == 2)
    return F.when(usable, trapezoid(x.cast("double"), F.coalesce(env["min"], F.greatest(F.lit(0.0), low - margin)), low, high, F.coalesce(env["max"], high + margin))).otherwise(1.0)


def categorical(kind: str, preferred: Column, measured: Column, unmeasured: float = 0.5) -> Column:
    """1 where nothing is preferred, ``unmeasured`` where nothing is measured, 0 for unknown pairs."""
    table = F.create_map(*[F.lit(v) for p, row in MATCHES[kind].items() for m, value in row.items() for v in (f"{p}|{m}", value)])
    found = F.try_element_at(table, F.concat_ws("|", preferred, measured))
    return F.when(preferred.isNull(), 1.0).when(measured.isNull(), unmeasured).otherwise(F.coalesce(found, F.lit(0.0)))


def band(x: Column, low: Column, high: Column, softness: float) -> Column:
    """1 inside low..high with soft shoulders; 0.5 where x is unknown."""
    return F.when(x.isNull(), 0.5).otherwise(trapezoid(x.cast("double"), low - softness, low, high, high + softness))


def ramp_up(x: Column, threshold: Column, softness: float) -> Column:
    """Rises from threshold - softness to the threshold; a step without softness; 0 where x is unknown."""
    rising = clamp01((x - (threshold - softness)) / F.lit(softness)) if softness > 0 else F.when(x >= threshold, 1.0).otherwise(0.0)
    return F.when(x.isNull(), 0.0).otherwise(rising)


def geometric_mean(factors: list[tuple[Column, float]]) -> Column:
    """Weighted geometric mean; weights up to 0 leave a factor out, and without any it is 0."""
    used = [(v, float(w)) for v, w in factors if w > 0]
    if not used:
        return F.lit(0.0)
    total = used[0][1] * F.ln(F.greatest(used[0][0], F.lit(FLOOR)))
    for v, w in used[1:]:
        total = total + w * F.ln(F.greatest(v, F.lit(FLOOR)))
    return F.exp(total / F.lit(sum(w for _, w in used)))
