"""DuckDB SQL for the registered queries, written on its own: it shares constants with the operators,
not their expressions."""

from __future__ import annotations


from ..functions import projection
from ..operators.vectors import KEYWORDS
from ..sources.adapters import LITHOLOGIES
from ..sources.profiles import CATEGORY_CODES, CONIFER_CLASSES, HOST_CLASSES, PROFILES

TODAY = "DATE '2024-10-20'"
AS_OF = "FROM hourly WHERE time <= TIMESTAMP '2024-08-15 12:00:00'"


def _q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _strings(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


def _profile_values() -> str:
    rows = []
    for p in PROFILES:
        e, t = p["static_envelope"], p["dynamic_triggers"]
        v, g, lag = e["elevation_m"], e["slope_deg"], t["lag_days"]
        rows.append(
            f"({_q(p['id'])}, {v['min']}.0::DOUBLE, {v['opt'][0]}.0::DOUBLE, {v['opt'][1]}.0::DOUBLE, {v['max']}.0::DOUBLE, {g['opt'][0]}.0::DOUBLE, {g['opt'][1]}.0::DOUBLE, {_q(e['aspect'])}, {_q(e['soil_ph'])}, {p['phenology_months']}, "
            f"{t['rain_window_days']}, {t['cumulative_rain_mm']}.0::DOUBLE, {t['thermal_shock_c']}.0::DOUBLE, {t['soil_temp_c']['min']}.0::DOUBLE, {t['soil_temp_c']['max']}.0::DOUBLE, {lag['opt'][0]}.0::DOUBLE, {lag['opt'][1]}.0::DOUBLE, {t['moisture_floor']}::DOUBLE)"
        )
    return "(VALUES " + ", ".join(rows) + ") AS p(species, e0, e1, e2, e3, s1, s2, p_aspect, p_ph, months, n_rain, r_thr, k_thr, t0, t1, l1, l2, m_floor)"


PROFILE = f"profile AS (SELECT * FROM {_profile_values()})"
WEIGHT = "weight AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(p['id'])}, {_q(c)}, {w}::DOUBLE)" for p in PROFILES for c, w in p["host_genera"].items()) + ") AS w(species, cls, w))"
CELLS = f"""cells AS (SELECT o_orderkey AS cell_key,
  605000.0::DOUBLE + ((o_custkey // 8) % 40) * 2200.0::DOUBLE + (o_orderkey * 7919 % 22000) / 10.0::DOUBLE AS x,
  5060000.0::DOUBLE + ((o_custkey // 8) // 40) * 2200.0::DOUBLE + (o_orderkey * 104729 % 22000) / 10.0::DOUBLE AS y,
  o_totalprice / 250.0::DOUBLE AS elevation_m,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey * 13 % 450) / 10.0::DOUBLE END AS slope_deg,
  CASE o_orderkey % 4 WHEN 0 THEN 'warm' WHEN 1 THEN 'cool' WHEN 2 THEN 'neutral' END AS aspect,
  CASE o_orderkey % 5 WHEN 0 THEN 'acidic' WHEN 1 THEN 'acidic' WHEN 2 THEN 'neutral' WHEN 3 THEN 'calcareous' END AS soil_ph,
  o_custkey % 23 AS ix, {_strings(HOST_CLASSES)}[(o_custkey % 23 + 1)::BIGINT] AS cls,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS canopy_alive,
  (o_orderkey * 31 % 101) / 100.0::DOUBLE AS forest_fraction
  FROM orders)"""


def trap(x, a, b, c, d) -> str:
    return f"(CASE WHEN {x} <= {a} THEN (CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) WHEN {x} < {b} THEN ({x} - {a}) / ({b} - {a}) WHEN {x} <= {c} THEN 1.0 WHEN {x} < {d} THEN ({d} - {x}) / ({d} - {c}) ELSE (CASE WHEN {c} = {d} THEN 1.0 ELSE 0.0 END) END)::DOUBLE"


def _match(pref: str, value: str, table: dict) -> str:
    whens = " ".join(f"WHEN {_q(p + '|' + v)} THEN {w}" for p, row in table.items() for v, w in row.items())
    return f"(CASE WHEN {pref} IS NULL THEN 1.0 WHEN {value} IS NULL THEN 0.5 ELSE (CASE {pref} || '|' || {value} {whens} ELSE 0.0 END) END)::DOUBLE"


# Soft matches of categories, as in the membership functions.
ASPECT = {"warm": {"warm": 1.0, "neutral": 0.5, "cool": 0.1}, "cool": {"cool": 1.0, "neutral": 0.5, "warm": 0.1}, "neutral": {"neutral": 1.0, "warm": 0.6, "cool": 0.6}}
SOIL = {"acidic": {"acidic": 1.0, "neutral": 0.6, "calcareous": 0.15}, "tolerant": {"acidic": 0.9, "neutral": 0.9, "calcareous": 0.8}}
MEMBERS = f"""members AS (SELECT c.cell_key, c.x, c.y, p.species,
  CASE WHEN c.ix IN (20, 21) THEN 1.0 WHEN c.ix = 22 THEN 0.0
    ELSE least(1.0, greatest(0.0, coalesce(w.w, 0.0) * (CASE WHEN c.cls IN ({', '.join(map(_q, CONIFER_CLASSES))}) THEN coalesce(c.canopy_alive, 1.0) ELSE 1.0 END))) END::DOUBLE AS m_host,
  coalesce(c.forest_fraction, 1.0) AS m_habitat_gate,
  CASE WHEN c.elevation_m IS NULL THEN 1.0 ELSE {trap('c.elevation_m', 'e0', 'e1', 'e2', 'e3')} END AS m_elevation,
  CASE WHEN c.slope_deg IS NULL THEN 1.0 ELSE {trap('c.slope_deg', 'greatest(0.0::DOUBLE, s1 - 10)', 's1', 's2', '(s2 + 10)')} END AS m_slope,
  {_match('p_aspect', 'c.aspect', ASPECT)} AS m_aspect, {_match('p_ph', 'c.soil_ph', SOIL)} AS m_soil_ph, 0.5::DOUBLE AS m_drainage
  FROM cells c CROSS JOIN profile p LEFT JOIN weight w ON w.species = p.species AND w.cls = c.cls)"""


def _mean(weights) -> str:
    terms = " + ".join(f"{w} * ln(greatest(m_{c}, 1e-6))" for c, w in weights if w)
    return f"exp(({terms}) / {sum(w for _, w in weights)}::DOUBLE)"


FULL = [("elevation", 1.0), ("slope", 0.5), ("aspect", 0.8), ("soil_ph", 0.8), ("drainage", 0.5)]
SCORED = f"scored AS (SELECT cell_key, x, y, species, round(m_host * {_mean(FULL)} * m_habitat_gate, 9) AS score FROM members)"
S = f"WITH {PROFILE}, {WEIGHT}, {CELLS}, {MEMBERS}, {SCORED}"
HOURLY = """hourly AS (SELECT event_id, user_id AS station,
  'm2200_' || floor((605000.0::DOUBLE + (user_id % 40) * 2200.0 + 1100.0) / 2200.0)::BIGINT || '_' || floor((5060000.0::DOUBLE + (user_id // 40) * 2200.0 + 1100.0) / 2200.0)::BIGINT AS meteo_cell_id,
  ts + INTERVAL '150' DAY + (user_id % 7)::INT * INTERVAL '30' DAY AS time,
  CASE WHEN event_type <> 'error' THEN value / 30.0::DOUBLE END AS precip,
  CASE WHEN event_id % 7 <> 0 THEN 10.0::DOUBLE + (event_id * 37 % 90) / 10.0::DOUBLE END AS soil_temp,
  CASE WHEN event_id % 11 <> 0 THEN 0.15::DOUBLE + (event_id * 53 % 200) / 1000.0::DOUBLE END AS soil_moist FROM events)"""
DAYS = """days AS (SELECT meteo_cell_id, time::DATE AS date, round(sum(precip), 6) AS precip_mm, round(avg(soil_temp), 6) AS soil_temp_c, round(avg(soil_moist), 6) AS soil_moist
  FROM hourly GROUP BY 1, 2 HAVING count(precip) > 0)"""
FEATURES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY meteo_cell_id ORDER BY date DESC) AS rn FROM days),
 rolled AS (SELECT meteo_cell_id, species, max(date) AS last_date, sum(precip_mm) FILTER (WHERE rn <= n_rain) AS rain,
   arg_min(soil_temp_c, rn) FILTER (WHERE soil_temp_c IS NOT NULL) AS temp, arg_min(soil_moist, rn) FILTER (WHERE soil_moist IS NOT NULL) AS moist,
   max(soil_temp_c) FILTER (WHERE rn <= 10) AS recent, min(rn) FILTER (WHERE precip_mm >= 10) - 1 AS days_since_trigger
   FROM numbered CROSS JOIN profile GROUP BY 1, 2),
 features AS (SELECT meteo_cell_id, species, last_date, month(last_date)::INT AS month, round_even(rain, 1) AS cumulative_rain_mm, round_even(temp, 1) AS soil_temp_c, round_even(moist, 3) AS soil_moisture,
   round_even(round(CASE WHEN recent IS NULL OR temp IS NULL OR temp = 0 THEN 0.0 ELSE greatest(0.0, recent - temp) END, 6), 1) AS thermal_shock_c, days_since_trigger FROM rolled)"""
READY = f"""parts AS (SELECT f.*, l1, l2,
   CASE WHEN list_contains(months, month) THEN 1.0 WHEN list_contains(months, month % 12 + 1) OR list_contains(months, (month + 10) % 12 + 1) THEN 0.15 ELSE 0.0 END::DOUBLE AS m_phenology,
   CASE WHEN soil_moisture IS NULL THEN 1.0 ELSE {trap('soil_moisture', '(m_floor - 0.05)', 'm_floor', '1.0', '1.0')} END AS m_moisture_gate,
   least(1.0, greatest(0.0, (cumulative_rain_mm - (r_thr - 15)) / 15.0)) AS m_rain,
   CASE WHEN soil_temp_c IS NULL THEN 0.5 ELSE {trap('soil_temp_c', '(t0 - 3)', 't0', 't1', '(t1 + 3)')} END AS m_soil_temp,
   least(1.0, greatest(0.0, (thermal_shock_c - (k_thr - 3)) / 3.0)) AS m_shock,
   CASE WHEN days_since_trigger IS NULL THEN 1.0 ELSE {trap('days_since_trigger', 'greatest(0.0::DOUBLE, l1 - 6)', 'l1', 'l2', '(l2 + 6)')} END AS m_lag
   FROM features f JOIN profile p USING (species)),
 ready AS (SELECT *, m_phenology * m_moisture_gate * {_mean([('rain', 1.0), ('soil_temp', 1.0), ('shock', 1.0), ('lag', 1.0)])} AS readiness,
   m_phenology * m_moisture_gate * {_mean([('rain', 1.0), ('soil_temp', 1.0), ('shock', 1.0)])} AS charge FROM parts),
 phased AS (SELECT *, m_phenology <> 0 AND m_moisture_gate <> 0 AND charge >= 0.5 AND days_since_trigger IS NOT NULL AS open FROM ready),
 phases AS (SELECT meteo_cell_id, species, readiness, charge, CASE WHEN open THEN days_since_trigger::INT END AS dst,
   CASE WHEN open AND days_since_trigger < l1 THEN 'in_fieri' WHEN open AND days_since_trigger <= l2 THEN 'pronto' WHEN open AND days_since_trigger <= 2 * l2 THEN 'tardi' END AS state,
   CASE WHEN open AND days_since_trigger < l1 THEN round_even(l1 - days_since_trigger, 0)::INT END AS eta,
   CASE WHEN open AND days_since_trigger > l2 AND days_since_trigger <= 2 * l2 THEN round_even(days_since_trigger - l2, 0)::INT END AS days_past FROM phased)"""
M = f"WITH {PROFILE}, {HOURLY}, {DAYS}, {FEATURES}, {READY}"
RAIN = "round_even(round(rain, 6), 1)"  # a sum halfway between two tenths must not depend on the order of its terms
EXACT = f"WITH {PROFILE}, {HOURLY}, {DAYS}, {FEATURES.replace('round_even(rain, 1)', RAIN)}"
SM = f"{S}, {HOURLY}, {DAYS}, {FEATURES}, {READY}"
WCELL = "'m2200_' || floor(x / 2200.0)::BIGINT || '_' || floor(y / 2200.0)::BIGINT"
ABOVE = "score::FLOAT > 0.4::FLOAT"
CANDIDATES = f"candidates AS (SELECT DISTINCT {WCELL} AS meteo_cell_id FROM scored WHERE {ABOVE})"
PHASED = f"""phased_cells AS (SELECT DISTINCT c.species, c.meteo_cell_id, state, readiness, charge, dst, eta, days_past
  FROM (SELECT DISTINCT species, {WCELL} AS meteo_cell_id FROM scored WHERE {ABOVE}) c JOIN phases p ON p.species = c.species AND p.meteo_cell_id = c.meteo_cell_id WHERE state IS NOT NULL)"""


def _top(mode: str) -> str:
    ready = "1.0::DOUBLE" if mode == "static" else "coalesce(round(p.readiness, 9), 0.0)"
    score = {"static": "suitability", "dynamic": "readiness", "both": "suitability * readiness"}[mode]
    return f"""{SM}, rows AS (SELECT s.species, s.score AS suitability, {ready} AS readiness, s.x, s.y FROM (SELECT *, {WCELL} AS mc FROM scored WHERE {ABOVE}) s
      LEFT JOIN phases p ON p.species = s.species AND p.meteo_cell_id = s.mc),
    valued AS (SELECT *, {score} AS score FROM rows WHERE {score} > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY species, floor(x / 1500.0), floor(y / 1500.0) ORDER BY score DESC, suitability DESC, readiness DESC, x DESC, y DESC) AS r FROM valued),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY score DESC, suitability DESC, readiness DESC, x DESC, y DESC)::INT AS rank FROM best WHERE r = 1)
    """


_TOP = "SELECT species, rank, round(score, 3) AS score, round(suitability, 3) AS suitability, round(readiness, 3) AS readiness, round(x, 1) AS x, round(y, 1) AS y FROM ranked WHERE rank <= 50"


REDUCED = [("elevation", 1.0), ("slope", 0.5), ("drainage", 0.5)]


def _boyce(name: str, scores: str, points: str = "") -> str:
    present = "(cell_key * 17) % 101 < (cell_key * 31) % 101"
    points = points or f"SELECT species, score, 'bg' AS kind FROM {scores} UNION ALL SELECT species, score, 'pres' FROM {scores} WHERE {present}"
    return f"""pts{name} AS ({points}),
    ext{name} AS (SELECT species, min(score) AS lo, max(score) AS hi, count(*) FILTER (WHERE kind = 'pres') AS np, count(*) FILTER (WHERE kind = 'bg') AS nb FROM pts{name} GROUP BY 1),
    win{name} AS (SELECT *, (hi - lo) * 0.1::DOUBLE AS w, ((hi - lo) - (hi - lo) * 0.1::DOUBLE) / 99 AS step, k::INT AS win FROM ext{name}, range(100) t(k)),
    cen{name} AS (SELECT *, lo + w / 2 + win * step AS center FROM win{name}),
    cnt{name} AS (SELECT c.species, c.win, c.center, count(*) FILTER (WHERE kind = 'pres') / any_value(np)::DOUBLE AS f, count(*) FILTER (WHERE kind = 'bg') / any_value(nb)::DOUBLE AS e
      FROM cen{name} c JOIN pts{name} p ON p.species = c.species AND p.score >= c.center - c.w / 2 AND p.score <= c.center + c.w / 2 GROUP BY 1, 2, 3),
    cur{name} AS (SELECT species, win, center, f / e AS pe FROM cnt{name} WHERE e > 0),
    rnk{name} AS (SELECT species, row_number() OVER (PARTITION BY species ORDER BY center) AS r1, row_number() OVER (PARTITION BY species ORDER BY pe, center) AS r2 FROM cur{name}),
    boy{name} AS (SELECT species, corr(r1, r2) AS boyce FROM rnk{name} GROUP BY 1)"""


PIXELS = """pixels AS (SELECT *, CASE (tile + row * 3 + col * 5) % 6 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE CASE WHEN tile % 3 = 0 THEN 50 ELSE 10 END END AS landcover, ((tile * 7 + row + col) % 90)::INT AS ph10 FROM (
  SELECT vec_id AS tile, ((i - 1) // 8)::INT AS row, ((i - 1) % 8)::INT AS col, 1000.0::DOUBLE + 2000.0::DOUBLE * embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)))"""
_AT = """SELECT p.cell_key, p.lat, """ + ", ".join(f"max(q.value) FILTER (WHERE q.row = p.row + {r} AND q.col = p.col + {c}) AS z{r + 1}{c + 1}_" for r in (-1, 0, 1) for c in (-1, 0, 1)) + """
    FROM points p JOIN pixels q ON q.tile = p.tile AND abs(q.row - p.row) <= 1 AND abs(q.col - p.col) <= 1 WHERE p.row BETWEEN 1 AND 6 AND p.col BETWEEN 1 AND 6 GROUP BY 1, 2"""
_GX, _GY = "((z02_ + 2 * z12_ + z22_) - (z00_ + 2 * z10_ + z20_))", "((z20_ + 2 * z21_ + z22_) - (z00_ + 2 * z01_ + z02_))"
TERRAIN_AT = f"""sten AS ({_AT}), gr AS (SELECT *, {_GX} / (8 * (0.0025::DOUBLE * 111320.0 * cos(radians(lat)))) AS gx, {_GY} / (8 * (0.0025::DOUBLE * 110540.0)) AS gy FROM sten),
  sh AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (degrees(atan2(-gx, -gy)) + 360.0) % 360.0 AS bearing FROM gr)
  SELECT cell_key, round_even(z11_, 1) AS elevation_m, round_even(slope, 1) AS slope_deg,
    CASE WHEN slope < 3 THEN 'neutral' WHEN bearing BETWEEN 112.5 AND 247.5 THEN 'warm' WHEN bearing >= 292.5 OR bearing <= 67.5 THEN 'cool' ELSE 'neutral' END AS aspect FROM sh"""
TERRAIN = """stencil AS (SELECT p.tile, p.row, p.col, p.value AS z11, """ + ", ".join(f"max(q.value) FILTER (WHERE q.row = p.row + {r} AND q.col = p.col + {c}) AS z{r + 1}{c + 1}_" for r in (-1, 0, 1) for c in (-1, 0, 1)) + """
    FROM pixels p JOIN pixels q ON q.tile = p.tile AND abs(q.row - p.row) <= 1 AND abs(q.col - p.col) <= 1 WHERE p.row BETWEEN 1 AND 6 AND p.col BETWEEN 1 AND 6 GROUP BY 1, 2, 3, 4),
  grad AS (SELECT *, ((z02_ + 2 * z12_ + z22_) - (z00_ + 2 * z10_ + z20_)) / (8 * 30.0) AS gx, ((z20_ + 2 * z21_ + z22_) - (z00_ + 2 * z01_ + z02_)) / (8 * 30.0) AS gy FROM stencil),
  shaped AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (degrees(atan2(-gx, -gy)) + 360.0) % 360.0 AS bearing FROM grad),
  terrain AS (SELECT tile, row, col, round_even(z11, 1) AS elevation_m, round_even(slope, 1) AS slope_deg,
    CASE WHEN slope < 3 THEN 'neutral' WHEN bearing BETWEEN 112.5 AND 247.5 THEN 'warm' WHEN bearing >= 292.5 OR bearing <= 67.5 THEN 'cool' ELSE 'neutral' END AS aspect FROM shaped)"""
SOIL_SAMPLE = "soil AS (SELECT tile, row, col, CASE WHEN ph10 > 0 THEN round_even(ph10 / 10.0::DOUBLE, 1) END AS soil_ph_value, CASE WHEN ph10 <= 0 THEN NULL WHEN ph10 / 10.0::DOUBLE < 6.2 THEN 'acidic' WHEN ph10 / 10.0::DOUBLE > 7.2 THEN 'calcareous' ELSE 'neutral' END AS soil_ph FROM pixels)"
_ON_TILE = """lon >= x0 AND lon < x0 + 8 * 0.0025::DOUBLE AND lat >= y0 - 8 * 0.0025::DOUBLE AND lat < y0"""
TILES = "tiles AS (SELECT vec_id AS tile, 10.0::DOUBLE + (vec_id % 50) * 0.02::DOUBLE AS x0, 46.0::DOUBLE + (vec_id // 50 + 1) * 0.02::DOUBLE AS y0 FROM embeddings)"
POINTS = f"""{TILES}, geo_points AS (SELECT o_orderkey AS cell_key, 10.0::DOUBLE + (o_orderkey * 7919 % 100003) / 100003.0::DOUBLE AS lon,
    46.0::DOUBLE + (o_orderkey * 104729 % 100003) / 100003.0::DOUBLE * 0.02::DOUBLE * (n // 50 + 2) AS lat FROM orders, (SELECT max(vec_id) AS n FROM embeddings)),
  points AS (SELECT cell_key, lon, lat, tile, x0, y0, least(7, greatest(0, floor((y0 - lat) / 0.0025::DOUBLE)))::INT AS row, least(7, greatest(0, floor((lon - x0) / 0.0025::DOUBLE)))::INT AS col
    FROM geo_points JOIN tiles ON {_ON_TILE})"""


def _cover(radius: int) -> str:
    return f"""cover AS (SELECT p.tile, p.row, p.col, count(*) FILTER (WHERE q.landcover = 10)::DOUBLE / nullif(count(*) FILTER (WHERE q.landcover <> 0), 0) AS forest, count(*) FILTER (WHERE q.landcover = 30)::DOUBLE / nullif(count(*) FILTER (WHERE q.landcover <> 0), 0) AS grass
      FROM pixels p JOIN pixels q ON q.tile = p.tile AND abs(q.row - p.row) <= {radius} AND abs(q.col - p.col) <= {radius} GROUP BY 1, 2, 3)"""


SCENES = f"""{PIXELS}, scenes AS (SELECT s::INT AS scene, tile, row, col, 4 + (tile + row + col + s) % 6 AS scl, 0.2::DOUBLE + ((tile * 3 + row * 5 + col * 7 + s) % 50) / 100.0::DOUBLE AS nir,
  ((tile + row * 2 + col + s) % 20) / 100.0::DOUBLE AS red, ((tile * 2 + row + col * 3 + s) % 25) / 100.0::DOUBLE AS swir FROM pixels, range(6) t(s) WHERE s * 7 < 25),
 idx AS (SELECT scene, tile, row, col, CASE WHEN scl BETWEEN 4 AND 7 AND nir + red <> 0 THEN (nir - red) / (nir + red) END AS ndvi, CASE WHEN scl BETWEEN 4 AND 7 AND nir + swir <> 0 THEN (nir - swir) / (nir + swir) END AS nbr FROM scenes),
 med AS (SELECT tile, row, col, median(ndvi) AS ndvi, median(nbr) AS nbr, count(DISTINCT scene) AS n_scenes FROM idx GROUP BY 1, 2, 3),
 comp AS (SELECT tile, row, col, round(ndvi, 6) AS ndvi, round(nbr, 6) AS nbr, n_scenes, CASE WHEN ndvi IS NOT NULL AND nbr IS NOT NULL THEN round(least(1.0, greatest(0.0, (ndvi - 0.45) / (0.78 - 0.45))) * least(1.0, greatest(0.0, (nbr - 0.20) / (0.55 - 0.20))), 6) END AS canopy_alive FROM med)"""


def _lith(region: str, descr: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains(upper({descr}), {_q(w)})" for w in words) + ")"
    return "CASE " + " ".join(f"WHEN {region} = '{r}' AND {has(k['calcareous'])} THEN 'calcareous' WHEN {region} = '{r}' AND {has(k['acidic'])} THEN 'acidic'" for r, k in KEYWORDS.items()) + f" WHEN {region} IN ({', '.join(map(_q, KEYWORDS))}) THEN 'neutral' END"


POLYGONS = f"""polys AS (SELECT *, {_strings(v for _, v in LITHOLOGIES)}[lith + 1] AS attr, {_strings(r for r, _ in LITHOLOGIES)}[lith + 1] AS region FROM (SELECT s_suppkey AS poly_id, 605000.0::DOUBLE + (s_suppkey * 7 % 40) * 2200.0::DOUBLE + 900.037::DOUBLE AS cx,
  5060000.0::DOUBLE + (s_suppkey * 3 % 5) * 2200.0::DOUBLE + 700.011::DOUBLE AS cy, 1500.0::DOUBLE + (s_suppkey % 7) * 400.0::DOUBLE AS a, s_suppkey % 13 AS lith FROM supplier)),
 rings AS (SELECT poly_id, cx, cy, a FROM polys UNION ALL SELECT poly_id, cx, cy, a / 2 FROM polys WHERE poly_id % 3 = 0 UNION ALL SELECT poly_id, cx + a * 2.5::DOUBLE, cy, a / 2 FROM polys WHERE poly_id % 5 = 0),
 held AS (SELECT cell_key, poly_id FROM cells JOIN rings ON abs(x - cx) + abs(y - cy) < a GROUP BY 1, 2 HAVING count(*) % 2 = 1),
 direct AS (SELECT cell_key, min(poly_id) AS poly_id FROM held GROUP BY 1)"""


def _edge(sx: int, sy: int) -> str:
    # distance to the edge from (cx + sx * a, cy) to (cx, cy + sy * a)
    px, py, dx, dy = f"(cx + {sx} * a)", "cy", f"(-({sx}) * a)", f"({sy} * a)"
    t = f"greatest(0.0, least(1.0, ((x - {px}) * {dx} + (y - {py}) * {dy}) / (2 * a * a)))"
    return f"sqrt(power({px} + {t} * {dx} - x, 2) + power({py} + {t} * {dy} - y, 2))"


NEAREST = f"""dists AS (SELECT c.cell_key, p.poly_id, least({', '.join(_edge(i, j) for i in (1, -1) for j in (1, -1))}) AS dist FROM (SELECT * FROM cells WHERE cell_key NOT IN (SELECT cell_key FROM direct)) c
    JOIN rings p ON abs(c.x - p.cx) <= p.a + 2000 AND abs(c.y - p.cy) <= p.a + 2000),
  near AS (SELECT cell_key, poly_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY dist, poly_id) AS r FROM dists WHERE dist <= 2000) WHERE r = 1)"""
GEOLOGY = f"""geo AS (SELECT g.cell_key, {_lith('region', 'attr')} AS soil_ph, attr AS geology_descr, fallback AS geology_fallback
  FROM (SELECT cell_key, poly_id, false AS fallback FROM direct UNION ALL SELECT cell_key, poly_id, true FROM near) g JOIN polys USING (poly_id))"""
MERGED = f"""{POINTS}, {TERRAIN}, {SOIL_SAMPLE}, merged AS (SELECT cell_key, elevation_m, slope_deg, aspect, coalesce(soil.soil_ph, geo.soil_ph) AS soil_ph, geology_fallback
  FROM points JOIN terrain USING (tile, row, col) LEFT JOIN geo USING (cell_key) LEFT JOIN soil USING (tile, row, col))"""
G = f"WITH {CELLS}, {POLYGONS}, {NEAREST}, {GEOLOGY}"


def _series(coef, trig, hyp, xi, eta, sign) -> str:
    return "".join(f" {sign} {c!r} * {trig}({2 * j} * {xi}) * {hyp}({2 * j} * {eta})" for j, c in enumerate(coef, 1))


def _inverse(x: str, y: str, name: str, source: str) -> str:
    """CTEs that add lat and lon (degrees) to ``source``."""
    p = projection
    lat = "chi" + "".join(f" + {d!r} * sin({2 * j} * chi)" for j, d in enumerate(p.DELTA, 1))
    return f"""i1{name} AS (SELECT *, {y} / {p.SCALE!r} AS xi, ({x} - 500000.0) / {p.SCALE!r} AS eta FROM {source}),
      i2{name} AS (SELECT *, xi{_series(p.BETA, 'sin', 'cosh', 'xi', 'eta', '-')} AS xi1, eta{_series(p.BETA, 'cos', 'sinh', 'xi', 'eta', '-')} AS eta1 FROM i1{name}),
      i3{name} AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM i2{name}),
      {name} AS (SELECT *, degrees({lat}) AS lat, 9.0 + degrees(atan2(sinh(eta1), cos(xi1))) AS lon FROM i3{name})"""


def _forward(lat: str, lon: str, name: str, source: str) -> str:
    """CTEs that add ux and uy (UTM metres) to ``source``."""
    p = projection
    return f"""f1{name} AS (SELECT *, radians({lat}) AS phi, radians({lon} - 9.0) AS lam FROM {source}),
      f2{name} AS (SELECT *, sinh(atanh(sin(phi)) - {p.ECC!r} * atanh({p.ECC!r} * sin(phi))) AS tt FROM f1{name}),
      f3{name} AS (SELECT *, atan2(tt, cos(lam)) AS fxi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS feta FROM f2{name}),
      {name} AS (SELECT *, 500000.0 + {p.SCALE!r} * (feta{_series(p.ALPHA, 'cos', 'sinh', 'fxi', 'feta', '+')}) AS ux, {p.SCALE!r} * (fxi{_series(p.ALPHA, 'sin', 'cosh', 'fxi', 'feta', '+')}) AS uy FROM f3{name})"""


def _grid(crs: str, resolution: float) -> str:
    """CTEs ``box`` (west, north, nx, ny) and ``target`` (i, j, fx, fy into the maps) of a served grid."""
    u, v = ("6378137.0 * radians(lon)", "6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))") if crs == "3857" else ("lon", "lat")
    lat, lon = ("degrees(2 * atan(exp(v / 6378137.0)) - pi() / 2)", "degrees(u / 6378137.0)") if crs == "3857" else ("v", "u")
    return f"""sides AS (SELECT unnest([{{'px': 605000.0::DOUBLE + t / 20.0::DOUBLE * 88000.0, 'py': 5060000.0::DOUBLE}}, {{'px': 605000.0 + t / 20.0::DOUBLE * 88000.0, 'py': 5104000.0}}, {{'px': 605000.0, 'py': 5060000.0 + t / 20.0::DOUBLE * 44000.0}}, {{'px': 693000.0, 'py': 5060000.0 + t / 20.0::DOUBLE * 44000.0}}], recursive := true) FROM range(21) r(t)),
      {_inverse('px', 'py', 'rim', 'sides')}, ends AS (SELECT min({u}) AS west, min({v}) AS south, max({u}) AS east, max({v}) AS north FROM rim),
      box AS (SELECT *, ceil((east - west) / {resolution})::BIGINT AS nx, ceil((north - south) / {resolution})::BIGINT AS ny FROM ends),
      spots AS (SELECT i::INT AS i, j::INT AS j, west + (j + 0.5) * {resolution}::DOUBLE AS u, north - (i + 0.5) * {resolution}::DOUBLE AS v FROM box, range(100000) a(i), range(100000) b(j) WHERE i < ny AND j < nx),
      ll AS (SELECT i, j, {lat} AS plat, {lon} AS plon FROM spots), {_forward('plat', 'plon', 'utm', 'll')},
      target AS (SELECT i, j, (ux - 605000.0) / 2200.0 AS fx, (5104000.0 - uy) / 2200.0 AS fy FROM utm)"""


# The cells' box in degrees and its corners (k: 0 south-west to 3 north-east) in UTM metres.
_BOX = f"""{_inverse('x', 'y', 'inv', 'cells')}, ends AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM inv),
  four AS (SELECT k, CASE WHEN k < 2 THEN a0 ELSE a1 END AS plat, CASE WHEN k % 2 = 0 THEN o0 ELSE o1 END AS plon FROM ends, range(4) t(k)), {_forward('plat', 'plon', 'corner', 'four')}"""
SERVED = """served AS (SELECT species, t.i, t.j, score, CASE WHEN score <= 0 THEN 0 ELSE greatest(0, least(255, round_even(score / 0.8 * 255.0, 0)))::INT END AS q FROM target t JOIN coarse c ON c.i = floor(fy) AND c.j = floor(fx))"""
_MAPPED = f"coarse AS (SELECT species, floor((5104000.0 - y) / 2200.0)::INT AS i, floor((x - 605000.0) / 2200.0)::INT AS j, max(score) AS score FROM scored GROUP BY 1, 2, 3)"
_QUANT = "quant AS (SELECT species, i, j, CASE WHEN score <= 0 THEN 0 ELSE greatest(0, least(255, round_even(score / 0.8 * 255.0, 0)))::INT END AS q FROM coarse)"
TARGETS = "targets AS (SELECT cell_key % (SELECT max(vec_id) + 1 FROM embeddings) AS tile, cell_key, cell_key * 7919 % 800 / 100.0::DOUBLE AS fy, cell_key * 104729 % 800 / 100.0::DOUBLE AS fx FROM cells)"
OBS = """obs AS (SELECT event_id AS id, ts, user_id, CASE WHEN event_id % 13 <> 0 THEN 605000.0::DOUBLE + (user_id % 40) * 2200.0 + 1100.0 END AS x, CASE WHEN event_id % 13 <> 0 THEN 5060000.0::DOUBLE + (user_id // 40) * 2200.0 + 1100.0 END AS y,
  CASE event_type WHEN 'click' THEN 'buono' WHEN 'view' THEN 'primordi' WHEN 'purchase' THEN 'vecchio' END AS phase, (event_type IN ('signup', 'error'))::INT AS is_blank,
  CASE WHEN event_id % 29 = 0 THEN 'abc' ELSE replace(json_extract_string(props, '$.k'), '.', ',') || ',5' END AS weight_text, event_id % 5 = 0 AS photo,
  CASE WHEN event_type <> 'signup' THEN ['amanita_caesarea', 'boletus_aereus', 'boletus_aestivalis', 'boletus_edulis', 'boletus_pinophilus', 'cantharellus_cibarius'][event_id % 6 + 1] END AS species FROM events),
 cleaned AS (SELECT *, try_cast(replace(weight_text, ',', '.') AS DOUBLE) AS weight_g, CASE WHEN weight_text IS NOT NULL AND try_cast(replace(weight_text, ',', '.') AS DOUBLE) IS NULL THEN 'weight_text' END AS error FROM obs)"""

ORACLE_SQL: dict[str, str] = {
    "static_suitability": f"{S} SELECT cell_key, species, score FROM scored",
    "static_breakdown": f"{S} SELECT cell_key, species, " + ", ".join(f"round(m_{c}, 10) AS m_{c}" for c in ("host", "habitat_gate", "elevation", "slope", "aspect", "soil_ph", "drainage")) + " FROM members",
    "map_stats": f"{S} SELECT species, round(max(score), 6) AS max_score, count(*) FILTER (WHERE {ABOVE}) AS n_candidates, count(*) FILTER (WHERE score > 0) AS n_scored, least(300, count(*) FILTER (WHERE {ABOVE})) AS n_top FROM scored GROUP BY 1",
    "map_topk": f"{S} SELECT species, rank, cell_key, score FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY score DESC, cell_key)::INT AS rank FROM scored WHERE {ABOVE}) WHERE rank <= 300",
    "species_subset": f"{S} SELECT species, count(*) FILTER (WHERE {ABOVE}) AS n_above, count(*) AS n_cells FROM scored WHERE species IN ('boletus_edulis', 'cantharellus_cibarius') GROUP BY 1",
    "custom_weights": f"{S} SELECT species, round(avg(m_host * {_mean([('elevation', 2.0), ('aspect', 1.0), ('soil_ph', 1.0)])} * m_habitat_gate), 6) AS mean_score FROM members GROUP BY 1",
    "meteo_daily": f"{M} SELECT * FROM days",
    "meteo_asof": f"WITH {HOURLY}, {DAYS.replace('FROM hourly', AS_OF)} SELECT meteo_cell_id, count(*) AS n_days, max(date) AS last_date, round(sum(precip_mm), 4) AS rain FROM days GROUP BY 1",
    "meteo_features": f"{EXACT} SELECT meteo_cell_id, species, last_date, month, cumulative_rain_mm, soil_temp_c, soil_moisture, thermal_shock_c, days_since_trigger FROM features",
    "meteo_history": f"""{EXACT}, h AS (SELECT *, row_number() OVER w AS rn, sum(precip_mm) OVER (PARTITION BY meteo_cell_id ORDER BY date ROWS 14 PRECEDING) AS rain, last_value(soil_temp_c IGNORE NULLS) OVER w AS temp,
        last_value(soil_moist IGNORE NULLS) OVER w AS moist, max(soil_temp_c) OVER (PARTITION BY meteo_cell_id ORDER BY date ROWS 9 PRECEDING) AS recent FROM days WINDOW w AS (PARTITION BY meteo_cell_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
      h2 AS (SELECT *, last_value(CASE WHEN precip_mm >= 10 THEN rn END IGNORE NULLS) OVER (PARTITION BY meteo_cell_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS trig FROM h)
      SELECT meteo_cell_id, date, {RAIN} AS cumulative_rain_mm, round_even(temp, 1) AS soil_temp_c, round_even(moist, 3) AS soil_moisture,
        round_even(round(CASE WHEN recent IS NULL OR temp IS NULL OR temp = 0 THEN 0.0 ELSE greatest(0.0, recent - temp) END, 6), 1) AS thermal_shock_c, rn - trig AS days_since_trigger FROM h2""",
    "readiness": f"{M} SELECT meteo_cell_id, species, round(readiness, 6) AS readiness, round(charge, 6) AS charge FROM ready",
    "readiness_breakdown": f"{M} SELECT meteo_cell_id, species, " + ", ".join(f"round(m_{c}, 6) AS m_{c}" for c in ("phenology", "moisture_gate", "rain", "soil_temp", "shock", "lag")) + " FROM ready",
    "phase_by_cell": f"{SM}, {PHASED} SELECT species, meteo_cell_id, state, round_even(readiness, 3) AS readiness, round_even(charge, 3) AS charge, dst, eta, days_past FROM phased_cells",
    "phase_counts": f"{SM}, {PHASED} SELECT species, state, count(*) AS n FROM phased_cells GROUP BY 1, 2",
    "combined_prediction": f"""{SM}, v AS (SELECT s.species, s.score * coalesce(round(p.readiness, 9), 0.0) AS v FROM (SELECT *, {WCELL} AS mc FROM scored) s LEFT JOIN phases p ON p.species = s.species AND p.meteo_cell_id = s.mc)
      SELECT species, round(sum(v), 4) AS total, round(max(v), 6) AS best, count(*) FILTER (WHERE v > 0) AS n_positive FROM v GROUP BY 1""",
    "candidate_cells": f"{S}, {CANDIDATES} SELECT * FROM candidates",
    "candidate_cells_capped": f"{S} SELECT meteo_cell_id FROM (SELECT {WCELL} AS meteo_cell_id, max(score) AS best FROM scored WHERE {ABOVE} GROUP BY 1 ORDER BY best DESC, meteo_cell_id LIMIT 25)",
    "archive_upsert": f"{M} SELECT meteo_cell_id, date, round(precip_mm + CASE WHEN day(date) % 3 = 0 THEN 2 ELSE 0 END, 5) AS precip_mm, soil_temp_c, soil_moist FROM days",
    "archive_status": f"{M} SELECT meteo_cell_id, count(DISTINCT date) AS n_days, max(date) AS last_date FROM days GROUP BY 1",
    "archive_gaps": f"{SM}, {CANDIDATES}, st AS (SELECT meteo_cell_id, max(date) AS last_date FROM days GROUP BY 1) SELECT meteo_cell_id, last_date FROM candidates LEFT JOIN st USING (meteo_cell_id) WHERE last_date IS NULL OR last_date < {TODAY} - 1",
    "backfill_todo": f"{SM}, {CANDIDATES}, st AS (SELECT meteo_cell_id, count(DISTINCT date) AS n, max(date) AS last_date FROM days GROUP BY 1) SELECT meteo_cell_id FROM candidates WHERE meteo_cell_id NOT IN (SELECT meteo_cell_id FROM st WHERE n >= 18 AND last_date >= {TODAY} - 4)",
    "gap_report_counts": f"{SM}, {CANDIDATES}, st AS (SELECT meteo_cell_id, max(date) AS last_date FROM days GROUP BY 1) SELECT count(*) AS n_gaps, count(*) FILTER (WHERE last_date IS NULL) AS n_empty FROM candidates LEFT JOIN st USING (meteo_cell_id) WHERE last_date IS NULL OR last_date < {TODAY} - 1",
    "boyce_by_species": f"{S}, {_boyce('', 'scored')} SELECT species, round(boyce, 6) AS boyce, np AS n_presence, nb AS n_background FROM ext JOIN boy USING (species)",
    "boyce_curve": f"{S}, {_boyce('', 'scored')} SELECT species, win, round(center, 6) AS center, round(pe, 6) AS pe FROM cur",
    "boyce_delta": f"""{S}, less AS (SELECT cell_key, species, round(m_host * {_mean(REDUCED)} * m_habitat_gate, 9) AS score FROM members), {_boyce('a', 'less')}, {_boyce('b', 'scored')}
      SELECT a.species, round(a.boyce, 6) AS baseline, round(b.boyce, 6) AS variant, round(b.boyce - a.boyce, 6) AS delta FROM boya a JOIN boyb b USING (species)""",
    "terrain_stencil": f"WITH {PIXELS}, {TERRAIN} SELECT * FROM terrain",
    "terrain_seamless": f"""WITH {PIXELS.replace('pixels AS (SELECT', 'cut AS (SELECT')}, whole AS (SELECT *, row - (tile // 50) * 8 AS gr, (tile % 50) * 8 + col AS gc FROM cut),
      stencil AS (SELECT p.tile, p.row, p.col, p.value AS z11, """ + ", ".join(f"max(q.value) FILTER (WHERE q.gr = p.gr + {r} AND q.gc = p.gc + {c}) AS z{r + 1}{c + 1}_" for r in (-1, 0, 1) for c in (-1, 0, 1)) + f"""
        FROM whole p, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc), whole q WHERE q.gr = p.gr + dr AND q.gc = p.gc + dc GROUP BY 1, 2, 3, 4 HAVING count(*) = 9), {TERRAIN[TERRAIN.index('grad AS'):]} SELECT * FROM terrain""",
    "regrid_seamless": f"""WITH {CELLS}, {PIXELS}, {TARGETS}, whole AS (SELECT row - (tile // 50) * 8 AS gr, (tile % 50) * 8 + col AS gc, value FROM pixels), spot AS (SELECT cell_key, fy - (tile // 50) * 8 AS gy, fx + (tile % 50) * 8 AS gx FROM targets),
      w AS (SELECT cell_key, value, (1 - abs(gr + 0.5 - gy)) * (1 - abs(gc + 0.5 - gx)) AS w FROM spot, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), whole WHERE gr = floor(gy - 0.5) + i AND gc = floor(gx - 0.5) + j) SELECT cell_key, round(sum(w * value) / sum(w), 5) AS value FROM w GROUP BY 1""",
    "raster_scan": f"WITH {PIXELS}, {TILES}, {SOIL_SAMPLE} SELECT tile, row, col, round(value, 6) AS elevation_m, landcover, soil_ph_value, soil_ph FROM pixels JOIN tiles USING (tile) JOIN soil USING (tile, row, col) WHERE x0 + (col + 0.5) * 0.0025::DOUBLE >= 10.25 AND x0 + (col + 0.5) * 0.0025::DOUBLE < 10.6 AND y0 - (row + 0.5) * 0.0025::DOUBLE >= 46.05 AND y0 - (row + 0.5) * 0.0025::DOUBLE < 46.15",
    "forest_layers": f"WITH {CELLS}, {POLYGONS.replace('WHERE poly_id % 5 = 0)', 'WHERE false)')} SELECT cell_key, {_strings([*CATEGORY_CODES, 'ZZ'])}[poly_id % 21 + 1] AS forest_category, {_strings(HOST_CLASSES)}[poly_id % 21 + 1] AS host_class FROM direct",
    "soil_ph_sample": f"WITH {PIXELS}, {SOIL_SAMPLE} SELECT * FROM soil",
    "canopy_sample": f"WITH {CELLS}, {PIXELS}, {POINTS} SELECT cells.cell_key, CASE WHEN value IS NOT NULL THEN round(least(1.0, greatest(0.0, value / 2000.0)), 6) END AS canopy_alive FROM cells LEFT JOIN points USING (cell_key) LEFT JOIN pixels USING (tile, row, col)",
    "landcover_fraction": f"WITH {PIXELS}, {_cover(2)} SELECT tile, row, col, round(forest, 6) AS forest_fraction, round(grass, 6) AS grassland_fraction FROM cover",
    "tiles_with_forest": f"WITH {PIXELS}, {_cover(1)} SELECT tile FROM cover GROUP BY tile HAVING bool_or(forest > 0.15) AND tile % 4 <> 0",
    "scene_indices": f"WITH {SCENES} SELECT scene, tile, row, col, round(ndvi, 6) AS ndvi, round(nbr, 6) AS nbr FROM idx",
    "scene_median": f"WITH {SCENES} SELECT * FROM comp",
    "canopy_table": f"WITH {SCENES} SELECT tile, row, col, canopy_alive FROM comp",
    "canopy_stats": f"""WITH {SCENES} SELECT round(avg(canopy_alive), 9) AS mean_alive, round(avg((canopy_alive < 0.2)::INT), 9) AS share_cleared, round(avg((canopy_alive > 0.8)::INT), 9) AS share_intact, round(median(ndvi), 9) AS median_ndvi,
      round(median(nbr), 9) AS median_nbr, count(canopy_alive) AS n_valid FROM comp""",
    "canopy_calibration": f"""WITH {SCENES}, {CELLS}, {POLYGONS}, centres AS (SELECT tile, row, col, 605000.0::DOUBLE + ((tile % 200) * 8 + col + 0.5) * 55.0 AS px, 5066000.0::DOUBLE - (tile // 200 * 8 + row + 0.5) * 55.0 AS py FROM comp),
      mask AS (SELECT tile, row, col FROM centres JOIN rings ON abs(px - cx) + abs(py - cy) < a WHERE {_strings([*HOST_CLASSES, ''])}[poly_id % 21 + 1] IN ({', '.join(map(_q, CONIFER_CLASSES))}) GROUP BY tile, row, col, poly_id HAVING count(*) % 2 = 1), c AS (SELECT *, CASE WHEN canopy_alive < 0.2 THEN 'cleared' WHEN canopy_alive <= 0.8 THEN 'intermediate' ELSE 'intact' END AS cls FROM comp WHERE canopy_alive IS NOT NULL AND (tile, row, col) IN (SELECT (tile, row, col) FROM mask))
      SELECT cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(avg(ndvi), 9) AS mean_ndvi, round(stddev_pop(ndvi), 9) AS std_ndvi, round(avg(nbr), 9) AS mean_nbr, round(stddev_pop(nbr), 9) AS std_nbr FROM c GROUP BY cls""",
    "canopy_histogram": f"WITH {SCENES}, b AS (SELECT least(10, floor((nbr - -0.2) / ((0.9 - -0.2) / 11)))::INT AS bin FROM comp WHERE nbr BETWEEN -0.2 AND 0.9) SELECT k::INT AS bin, count(b.bin) AS n FROM range(11) t(k) LEFT JOIN b ON b.bin = k GROUP BY k",
    "geology_class": f"WITH {CELLS}, {POLYGONS} SELECT cell_key, poly_id, {_lith('region', 'attr')} AS soil_ph FROM direct JOIN polys USING (poly_id)",
    "geology_nearest": f"{G} SELECT cell_key, poly_id, round(dist, 3) AS dist FROM near",
    "geology_merged": f"{G} SELECT * FROM geo",
    "forest_host": f"WITH {CELLS}, {POLYGONS} SELECT cell_key, {_strings([*CATEGORY_CODES, 'ZZ'])}[poly_id % 21 + 1] AS forest_category, {_strings(HOST_CLASSES)}[poly_id % 21 + 1] AS host_class FROM direct",
    "layer_merge": f"{G}, {PIXELS}, {MERGED} SELECT * FROM merged",
    "suitability_at": f"""{G}, {PIXELS}, {MERGED}, {PROFILE}, m AS (SELECT c.cell_key, p.species, CASE WHEN c.elevation_m IS NULL THEN 1.0 ELSE {trap('c.elevation_m', 'e0', 'e1', 'e2', 'e3')} END AS m_elevation,
        CASE WHEN c.slope_deg IS NULL THEN 1.0 ELSE {trap('c.slope_deg', 'greatest(0.0::DOUBLE, s1 - 10)', 's1', 's2', '(s2 + 10)')} END AS m_slope, {_match('p_aspect', 'c.aspect', ASPECT)} AS m_aspect, {_match('p_ph', 'c.soil_ph', SOIL)} AS m_soil_ph, 0.5::DOUBLE AS m_drainage
        FROM merged c CROSS JOIN profile p) SELECT cell_key, species, round({_mean(FULL)}, 6) AS score FROM m""",
    "cell_ids": f"WITH {CELLS} SELECT cell_key, 's100_' || floor(x / 100.0)::BIGINT || '_' || floor(y / 100.0)::BIGINT AS static_cell_id, {WCELL} AS meteo_cell_id FROM cells",
    "cell_centers": f"""WITH {CELLS}, k AS (SELECT DISTINCT floor(x / 2200.0)::BIGINT AS c, floor(y / 2200.0)::BIGINT AS r FROM cells), kk AS (SELECT *, (c + 0.5::DOUBLE) * 2200.0::DOUBLE AS px, (r + 0.5::DOUBLE) * 2200.0::DOUBLE AS py FROM k), {_inverse('px', 'py', 'g', 'kk')}
      SELECT 'm2200_' || c || '_' || r AS meteo_cell_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM g""",
    "cell_polygons": f"""WITH {CELLS}, k AS (SELECT DISTINCT floor(x / 2200.0)::BIGINT AS c, floor(y / 2200.0)::BIGINT AS r FROM cells),
      kk AS (SELECT c, r, n, (c + (n IN (1, 2))::INT) * 2200.0::DOUBLE AS px, (r + (n IN (2, 3))::INT) * 2200.0::DOUBLE AS py FROM k, range(4) t(n)), {_inverse('px', 'py', 'g', 'kk')}
      SELECT 'm2200_' || c || '_' || r AS meteo_cell_id, """ + ", ".join(f"round_even(max({v}) FILTER (WHERE n = {n}), 5) AS {v}{n}" for n in range(4) for v in ("lon", "lat")) + """ FROM g GROUP BY c, r""",
    "homolosine": f"""WITH {CELLS}, {_inverse('x', 'y', 'g', 'cells')}, t0 AS (SELECT cell_key, radians(lat) AS t, pi() * sin(radians(lat)) AS goal, lon FROM g),
      """ + ", ".join(f"t{n + 1} AS (SELECT cell_key, t - (2 * t + sin(2 * t) - goal) / (2 + 2 * cos(2 * t)) AS t, goal, lon FROM t{n})" for n in range(8)) + """
      SELECT cell_key, round(6378137.0 * (radians(30.0) + 2 * sqrt(2.0) / pi() * radians(lon - 30.0) * cos(t)), 2) AS hx, round(6378137.0 * (sqrt(2.0) * sin(t) - 0.0528035274542), 2) AS hy FROM t8""",
    "projected_round_trip": f"WITH {CELLS}, {_inverse('x', 'y', 'g', 'cells')} SELECT cell_key, round(lat, 6) AS lat, round(lon, 6) AS lon, true AS returns FROM g",
    "quantised_grid": f"{S}, {_MAPPED}, {_QUANT} SELECT * FROM quant",
    "colour_grid": f"{S}, {_MAPPED} SELECT species, i, j, round(least(1.0, greatest(0.0, score / 0.8)), 6) AS norm, CASE WHEN score > 0.05 THEN 200 ELSE 0 END AS alpha FROM coarse",
    "point_lookup": f"""{S}, {_MAPPED}, {_QUANT}, {_grid('3857', 3000.0)}, {SERVED}, moved AS (SELECT cell_key, x, y AS my FROM cells), {_inverse('x', 'my', 'geo', 'moved')},
      p AS (SELECT cell_key, species, floor((north - 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))) / ((north - (north - ny * 3000.0::DOUBLE)) / ny))::INT AS i, floor((6378137.0 * radians(lon) - west) / (((west + nx * 3000.0::DOUBLE) - west) / nx))::INT AS j FROM geo, box, profile)
      SELECT cell_key, species, round(CASE WHEN q > 0 AND q / 255.0::DOUBLE * 0.8 >= 0.30 THEN q / 255.0::DOUBLE * 0.8 END, 6) AS score FROM p LEFT JOIN served USING (species, i, j)""",
    "served_rows": f"""{S}, {_MAPPED}, {_grid('3857', 3000.0)}, {SERVED}, every AS (SELECT species, i, j, nx, ny, west, north FROM (SELECT DISTINCT species, i FROM served), box, range(1000) r(j) WHERE j < nx)
      SELECT species, i, any_value(nx)::INT AS nx, any_value(ny)::INT AS ny, round(any_value(west), 3) AS west, round(any_value(north - ny * 3000.0::DOUBLE), 3) AS south, round(any_value(west + nx * 3000.0::DOUBLE), 3) AS east, round(any_value(north), 3) AS north, base64(unhex(string_agg(printf('%02X', coalesce(q, 0)), '' ORDER BY j))) AS cells FROM every LEFT JOIN served USING (species, i, j) GROUP BY 1, 2""",
    "overlay_grid": f"""{S}, {_MAPPED}, {_grid('4326', 0.02)}, w AS (SELECT c.species, t.i, t.j, score, (1 - abs(c.i + 0.5 - fy)) * (1 - abs(c.j + 0.5 - fx)) AS w FROM target t JOIN coarse c ON c.i IN (floor(fy - 0.5), floor(fy - 0.5) + 1) AND c.j IN (floor(fx - 0.5), floor(fx - 0.5) + 1)),
      v AS (SELECT species, i, j, round(sum(w * score) / sum(w), 9) AS score FROM w GROUP BY 1, 2, 3)
      SELECT species, i, j, round(least(1.0, greatest(0.0, score / 0.8)), 6) AS norm, CASE WHEN score > 0.05 THEN 200 ELSE 0 END AS alpha FROM v""",
    "overlay_bounds": f"""{S}, {_MAPPED}, {_grid('4326', 0.02)}, w AS (SELECT c.species, t.i, t.j, score, (1 - abs(c.i + 0.5 - fy)) * (1 - abs(c.j + 0.5 - fx)) AS w FROM target t JOIN coarse c ON c.i IN (floor(fy - 0.5), floor(fy - 0.5) + 1) AND c.j IN (floor(fx - 0.5), floor(fx - 0.5) + 1)),
      v AS (SELECT species, i, j, round(sum(w * score) / sum(w), 9) AS score FROM w GROUP BY 1, 2, 3)
      SELECT species, count(*) FILTER (WHERE score > 0.05) AS n_visible, round(max(least(1.0, greatest(0.0, score / 0.8))), 6) AS largest, round(any_value(west), 6) AS west, round(any_value(north - ny * 0.02::DOUBLE), 6) AS south, round(any_value(west + nx * 0.02::DOUBLE), 6) AS east, round(any_value(north), 6) AS north, any_value(nx)::INT AS nx, any_value(ny)::INT AS ny FROM v, box GROUP BY 1""",
    "species_menu": f"""{S}, have AS (SELECT species, count(*) AS n_candidates FROM scored WHERE {ABOVE} GROUP BY 1) SELECT species, common_name, n_candidates, row_number() OVER (ORDER BY common_name, species)::INT AS place FROM have JOIN (VALUES """ + ", ".join(f"({_q(x['id'])}, {_q(x['common_name'])})" for x in PROFILES) + """) AS c(species, common_name) USING (species)""",
    "grid_cells": f"""WITH {CELLS}, {_BOX}, b AS (SELECT floor(min(ux) / 1000.0)::BIGINT AS c0, floor(max(ux) / 1000.0)::BIGINT AS c1, floor(min(uy) / 1000.0)::BIGINT AS r0, floor(max(uy) / 1000.0)::BIGINT AS r1 FROM corner),
      sq AS (SELECT c AS col, r AS row, (c + 0.5::DOUBLE) * 1000.0::DOUBLE AS px, (r + 0.5::DOUBLE) * 1000.0::DOUBLE AS py FROM (SELECT c, unnest(range(r0, r1 + 1)) AS r FROM (SELECT r0, r1, unnest(range(c0, c1 + 1)) AS c FROM b))), {_inverse('px', 'py', 'ctr', 'sq')},
      n AS (SELECT floor(x / 1000.0)::BIGINT AS col, floor(y / 1000.0)::BIGINT AS row, count(*) AS n_cells FROM cells GROUP BY 1, 2) SELECT col, row, px AS x, py AS y, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(n_cells, 0) AS n_cells FROM ctr LEFT JOIN n USING (col, row)""",
    "map_cells": f"""{S}, {_BOX}, b AS (SELECT min(ux) AS x0, max(uy) AS y1, ceil((max(ux) - min(ux)) / 2000.0)::BIGINT AS nx, ceil((max(uy) - min(uy)) / 2000.0)::BIGINT AS ny FROM corner),
      best AS (SELECT floor((y1 - y) / 2000.0)::INT AS i, floor((x - x0) / 2000.0)::INT AS j, species, max(score) AS score FROM scored, b GROUP BY 1, 2, 3)
      SELECT i, j, round(x0 + (j + 0.5) * 2000.0::DOUBLE, 3) AS x, round(y1 - (i + 0.5) * 2000.0::DOUBLE, 3) AS y, species, round(score, 6) AS score FROM (SELECT b.*, i::INT AS i, j::INT AS j FROM b, range(1000) t(i), range(1000) u(j) WHERE i < ny AND j < nx) LEFT JOIN best USING (i, j)""",
    "grid_dimensions": f"""WITH {CELLS}, {_BOX}, b AS (SELECT max(ux) FILTER (WHERE k = 0) AS x0, max(uy) FILTER (WHERE k = 0) AS y0, max(ux) FILTER (WHERE k = 3) AS x1, max(uy) FILTER (WHERE k = 3) AS y1 FROM corner),
      n AS (SELECT floor(abs(x1 - x0) / 100.0)::BIGINT + 1 AS n_col, floor(abs(y1 - y0) / 100.0)::BIGINT + 1 AS n_row FROM b) SELECT n_col, n_row, n_col * n_row AS n_cells FROM n""",
    "named_places": f"""WITH {CELLS}, {_inverse('x', 'y', 'geo', 'cells')}, k AS (SELECT cell_key, printf('%.4f,%.4f', lat, lon) AS k FROM geo), landed AS (SELECT k, min('place ' || cell_key) AS n, min('a place ' || cell_key) FILTER (WHERE cell_key % 6 = 0) AS m FROM k WHERE cell_key % 3 = 0 GROUP BY 1)
      SELECT cell_key, coalesce(m, n) AS name FROM k LEFT JOIN landed USING (k)""",
    "scene_selection": f"WITH {SCENES.replace('WHERE s * 7 < 25)', 'WHERE s * 7 < 25 AND s BETWEEN 1 AND 6 AND 10.0 + (s % 4) * 1.2 <= 13.15)')} SELECT * FROM comp",
    "random_validation": f"""{S}, {_MAPPED}, {OBS}, pts0 AS (SELECT id, 45.65::DOUBLE + ('0x' || md5(id || ':7:1')[1:13])::BIGINT / 4503599627370496.0::DOUBLE * (46.1::DOUBLE - 45.65::DOUBLE) AS plat, 10.35::DOUBLE + ('0x' || md5(id || ':7:2')[1:13])::BIGINT / 4503599627370496.0::DOUBLE * (11.5::DOUBLE - 10.35::DOUBLE) AS plon FROM range((SELECT count(*) FROM cells)) t(id)), {_forward('plat', 'plon', 'ground', 'pts0')}, {_boyce('', '', """SELECT species, score, 'pres' AS kind FROM cleaned o JOIN coarse m USING (species) WHERE error IS NULL AND x IS NOT NULL AND i = floor((5104000.0 - y) / 2200.0) AND j = floor((x - 605000.0) / 2200.0)
        UNION ALL SELECT species, score, 'bg' FROM ground JOIN coarse m ON i = floor((5104000.0 - uy) / 2200.0) AND j = floor((ux - 605000.0) / 2200.0)""")} SELECT species, round(boyce, 6) AS boyce, np AS n_presence, nb AS n_background FROM ext JOIN boy USING (species)""",
    "geojson_pins": f"""WITH {OBS}, k AS (SELECT * FROM cleaned WHERE error IS NULL AND x IS NOT NULL), {_inverse('x', 'y', 'g', 'k')}
      SELECT id, '{{"type":"Feature","properties":{{' || concat_ws(',', '"species":"' || species || '"', '"phase":"' || phase || '"', '"weight_g":' || round_even(weight_g, 1)::VARCHAR, '"is_blank":' || is_blank, '"photo":' || photo::VARCHAR) || '}},"geometry":{{"type":"Point","coordinates":[' || round_even(lon, 5)::VARCHAR || ',' || round_even(lat, 5)::VARCHAR || ']}}}}' AS geojson FROM g""",
    "suitability_table": f"""{S}, other AS (SELECT species, round(m_host * {_mean([('elevation', 2.0), ('aspect', 1.0), ('soil_ph', 1.0)])} * m_habitat_gate, 9) AS score FROM members WHERE species IN ('boletus_edulis', 'cantharellus_cibarius')),
      t AS (SELECT species, score FROM scored WHERE species NOT IN ('boletus_edulis', 'cantharellus_cibarius') UNION ALL SELECT * FROM other)
      SELECT species, count(*) AS n_cells, count(*) FILTER (WHERE {ABOVE}) AS n_above, round(avg(score::FLOAT::DOUBLE), 5) AS mean_score FROM t GROUP BY 1""",
    "species_list": f"{S} SELECT DISTINCT species, upper(species[1]) || lower(replace(species[2:], '_', ' ')) AS name FROM scored WHERE {ABOVE}",
    "tile_lookup": f"WITH {POINTS} SELECT cell_key, tile, row, col FROM points",
    "terrain_at": f"WITH {POINTS}, {PIXELS}, {TERRAIN_AT}",
    "landcover_at": f"""WITH {POINTS}, {PIXELS}, seen AS (SELECT cell_key, landcover FROM points p JOIN pixels q ON q.tile = p.tile AND q.landcover <> 0 AND q.row BETWEEN ceil((y0 - lat - 0.004) / 0.0025 - 0.5) AND floor((y0 - lat + 0.004) / 0.0025 - 0.5)
        AND q.col BETWEEN ceil((lon - x0 - 0.004) / 0.0025 - 0.5) AND floor((lon - x0 + 0.004) / 0.0025 - 0.5))
      SELECT p.cell_key, round(count(*) FILTER (WHERE landcover = 10) / nullif(count(landcover), 0)::DOUBLE, 6) AS forest_fraction, round(count(*) FILTER (WHERE landcover = 30) / nullif(count(landcover), 0)::DOUBLE, 6) AS grassland_fraction FROM points p LEFT JOIN seen USING (cell_key) GROUP BY 1""",
    "landcover_window": f"""WITH {TILES.replace('tiles AS', 'corners AS')}, geo AS (SELECT o_orderkey AS cell_key, 10.0::DOUBLE + (o_orderkey * 7919 % 100003) / 100003.0::DOUBLE AS lon, 46.0::DOUBLE + (o_orderkey * 104729 % 100003) / 100003.0::DOUBLE * 0.02::DOUBLE * (n // 50 + 2) AS lat FROM orders, (SELECT max(vec_id) AS n FROM embeddings)),
      points AS (SELECT * FROM geo JOIN corners ON lon >= x0 AND lon < x0 + 64 * 0.0003125::DOUBLE AND lat >= y0 - 64 * 0.0003125::DOUBLE AND lat < y0),
      win AS (SELECT cell_key, tile, ceil((y0 - lat - 0.0025) / 0.0003125 - 0.5)::INT AS r0, floor((y0 - lat + 0.0025) / 0.0003125 - 0.5)::INT AS r1, ceil((lon - x0 - 0.0025) / 0.0003125 - 0.5)::INT AS c0, floor((lon - x0 + 0.0025) / 0.0003125 - 0.5)::INT AS c1 FROM points),
      seen AS (SELECT cell_key, (tile * 7 + r * 13 + c * 29 + (r // 5) * (c // 3)) % 9 AS k FROM win, range(64) a(r), range(64) b(c) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)
      SELECT cell_key, round(count(*) FILTER (WHERE k > 3) / nullif(count(*) FILTER (WHERE k > 0), 0)::DOUBLE, 6) AS forest_fraction, round(count(*) FILTER (WHERE k IN (1, 2)) / nullif(count(*) FILTER (WHERE k > 0), 0)::DOUBLE, 6) AS grassland_fraction FROM points LEFT JOIN seen USING (cell_key) GROUP BY 1""",
    "forest_regions": f"""WITH {TILES}, {PIXELS}, pts AS (SELECT tile AS region, a * 5 + b AS sample, x0 + (x0 + 0.02::DOUBLE - x0) * b / 4 AS lon, y0 - 0.02::DOUBLE + (y0 + 0.02::DOUBLE - (y0 - 0.02::DOUBLE)) * a / 4 AS lat FROM tiles, range(5) r(a), range(5) q(b)),
      on_t AS (SELECT * FROM pts JOIN tiles ON {_ON_TILE}),
      frac AS (SELECT region, sample, count(*) FILTER (WHERE landcover = 10) / count(*)::DOUBLE AS f FROM on_t p JOIN pixels q ON q.tile = p.tile AND q.landcover <> 0 AND q.row BETWEEN ceil((y0 - lat - 0.0025) / 0.0025 - 0.5) AND floor((y0 - lat + 0.0025) / 0.0025 - 0.5)
        AND q.col BETWEEN ceil((lon - x0 - 0.0025) / 0.0025 - 0.5) AND floor((lon - x0 + 0.0025) / 0.0025 - 0.5) GROUP BY 1, 2)
      SELECT DISTINCT region FROM frac WHERE f > 0.15 AND region % 8 <> 0""",
    "tile_manifest": f"""WITH {CELLS}, {_inverse('x', 'y', 'g', 'cells')}, b AS (SELECT floor(min(lat))::INT AS a0, floor(max(lat))::INT AS a1, floor(min(lon))::INT AS o0, floor(max(lon))::INT AS o1 FROM g)
      SELECT printf('%s%02d_%s%03d', CASE WHEN a < 0 THEN 'S' ELSE 'N' END, abs(a), CASE WHEN o < 0 THEN 'W' ELSE 'E' END, abs(o)) AS tile, a::INT AS lat, o::INT AS lon
        FROM (SELECT a, unnest(range(o0, o1 + 1)) AS o FROM (SELECT o0, o1, unnest(range(a0, a1 + 1)) AS a FROM b)) WHERE (a + o) % 2 <> 0""",
    "occurrence_ingest": f"""WITH rows AS (SELECT event_id, {_strings(sorted(p['id'] for p in PROFILES))}[event_id % 6 + 1] AS species, CASE WHEN event_id % 13 <> 0 THEN 44.5::DOUBLE + (event_id * 7919 % 3000) / 1000.0::DOUBLE END AS lat, 10.0::DOUBLE + (event_id * 104729 % 4000) / 1000.0::DOUBLE AS lon, year(ts)::INT AS year FROM events)
      SELECT species, lat, lon, year, event_id AS gbif_key FROM rows WHERE lat BETWEEN 45.2 AND 47.15 AND lon BETWEEN 10.35 AND 13.15 QUALIFY row_number() OVER (PARTITION BY species ORDER BY event_id) <= 1000""",
    "polygon_ingest": f"WITH {CELLS}, {POLYGONS} SELECT poly_id, attr, (1 + (poly_id % 3 = 0 OR poly_id % 5 = 0)::INT)::INT AS n_rings, (5 * (1 + (poly_id % 3 = 0 OR poly_id % 5 = 0)::INT))::INT AS n_points FROM polys WHERE poly_id % 11 <> 0 AND poly_id % 13 <> 0",
    "polygon_ingest_counters": "SELECT count(*) AS n_features, count(*) FILTER (WHERE s_suppkey % 11 = 0) AS n_no_geometry, 0::BIGINT AS n_invalid, count(*) FILTER (WHERE s_suppkey % 13 = 0) AS n_unnamed, count(*) FILTER (WHERE s_suppkey % 15 = 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0) AS n_repaired FROM supplier",
    "polygon_repair": f"""WITH {CELLS}, {POLYGONS} SELECT cell_key, min(poly_id) AS poly_id, arg_min(attr, poly_id) AS attr FROM cells JOIN polys ON abs(x - cx) < 2 * a AND abs(y - cy) < a AND CASE poly_id % 4 WHEN 0 THEN x > cx - a AND x < cx AND abs(y - cy) < cx - x
      WHEN 1 THEN abs(x - cx) + abs(y - cy) < a OR abs(x - cx - a) + abs(y - cy) < a WHEN 2 THEN abs(x - cx) + abs(y - cy) < a ELSE abs(x - cx) + abs(y - cy) < a AND abs(x - cx) + abs(y - cy) > a / 2 END GROUP BY 1""",
    "polygon_repair_counters": "SELECT count(*) AS n_features, 0::BIGINT AS n_no_geometry, 0::BIGINT AS n_invalid, 0::BIGINT AS n_unnamed, count(*) FILTER (WHERE s_suppkey % 4 <> 3) AS n_repaired FROM supplier",
    "stream_daily": f"{M} SELECT * FROM days",
    "stream_phases": f"{M} SELECT species, meteo_cell_id, state, round_even(readiness, 3) AS readiness, round_even(charge, 3) AS charge, dst, eta, days_past FROM phases WHERE state IS NOT NULL",
    "stream_features": f"{EXACT} SELECT meteo_cell_id, species, last_date, month, cumulative_rain_mm, soil_temp_c, soil_moisture, thermal_shock_c, days_since_trigger FROM features",
    "stream_gaps": f"{SM}, {CANDIDATES}, st AS (SELECT meteo_cell_id, max(date) AS last_date FROM days GROUP BY 1) SELECT meteo_cell_id, last_date FROM candidates LEFT JOIN st USING (meteo_cell_id) WHERE last_date IS NULL OR last_date < (SELECT max(date) FROM days) - 1",
    "stream_observations": f"WITH {OBS} SELECT id, species, phase, CASE WHEN x IS NOT NULL THEN 's100_' || floor(x / 100.0)::BIGINT || '_' || floor(y / 100.0)::BIGINT END AS static_cell_id, CASE WHEN x IS NOT NULL THEN {WCELL} END AS meteo_cell_id, error, CASE WHEN error IS NULL THEN 'clean' ELSE 'quarantine' END AS sink FROM cleaned",
    "hourly_feed": f"{M} SELECT * FROM days",
    "feed_mismatches": "SELECT user_id // 10 AS batch, count(DISTINCT user_id) + 1 AS n_requests, count(DISTINCT user_id) AS n_series FROM events WHERE user_id // 10 % 7 = 0 GROUP BY 1",
    "ingest_windows": """WITH m AS (SELECT max(s_suppkey) AS last FROM supplier)
      SELECT DISTINCT lo, lo + 24 AS hi, least(lo + 24, last) - lo + 1 AS at_most FROM (SELECT s_suppkey // 25 * 25 AS lo FROM supplier), m WHERE lo // 25 % 4 = 3""",
    "polygon_table": f"""WITH {CELLS}, {POLYGONS}, n AS (SELECT poly_id, attr, (1 + (poly_id % 3 = 0 OR poly_id % 5 = 0)::INT)::INT AS n_rings FROM polys WHERE poly_id % 11 <> 0 AND poly_id % 13 <> 0)
      SELECT 'geology' AS layer, * FROM n UNION ALL SELECT 'forest', * FROM n WHERE n_rings > 1""",
    "species_validation": f"""{S}, {_MAPPED}, {OBS}, {_boyce('', '', """SELECT species, score, 'pres' AS kind FROM cleaned o JOIN coarse m USING (species) WHERE error IS NULL AND x IS NOT NULL AND i = floor((5104000.0 - y) / 2200.0) AND j = floor((x - 605000.0) / 2200.0)
        UNION ALL SELECT species, score, 'bg' FROM cells c JOIN coarse m ON i = floor((5104000.0 - y) / 2200.0) AND j = floor((x - 605000.0) / 2200.0)""")} SELECT species, round(boyce, 6) AS boyce, np AS n_presence, nb AS n_background FROM ext JOIN boy USING (species)""",
    "profile_quality": f"""WITH r AS (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN '.yml' ELSE '.yaml' END AS tail, CASE WHEN p_partkey % 19 = 0 THEN 'other' ELSE 'part_' || p_partkey END AS species FROM part)
      SELECT 'part_' || p_partkey || tail AS file,
        concat_ws('; ', CASE WHEN p_size % 4 = 3 THEN 'trophic_mode: parasitic' END, CASE WHEN p_partkey % 3 = 2 THEN 'habitat: sea' END,
          CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 = 0 THEN 'unknown hosts: abetaia,bosco_' || p_size END,
          CASE WHEN p_size % 14 IN (0, 13) THEN 'month outside 1..12' END, CASE WHEN p_size % 4 = 0 AND p_partkey % 5 = 0 THEN 'mycorrhizal without hosts' END) AS errors,
        concat_ws('; ', CASE WHEN tail = '.yml' THEN 'file name' END, CASE WHEN tail = '.yml' OR species = 'other' THEN 'id differs from file name' END, CASE WHEN p_partkey % 23 = 0 THEN 'not a document' END) AS refused,
        upper(species[1]) || replace(species[2:], '_', ' ') AS name FROM r""",
    "geojson_occurrences": f"""WITH rows AS (SELECT event_id, {_strings(sorted(p['id'] for p in PROFILES))}[event_id % 6 + 1] AS species, CASE WHEN event_id % 13 <> 0 THEN 44.5::DOUBLE + (event_id * 7919 % 3000) / 1000.0::DOUBLE END AS lat, 10.0::DOUBLE + (event_id * 104729 % 4000) / 1000.0::DOUBLE AS lon, year(ts)::INT AS year FROM events),
      kept AS (SELECT * FROM rows WHERE lat BETWEEN 45.2 AND 47.15 AND lon BETWEEN 10.35 AND 13.15 QUALIFY row_number() OVER (PARTITION BY species ORDER BY event_id) <= 1000)
      SELECT event_id AS gbif_key, '{{"type":"Feature","properties":{{"species":"' || species || '","year":' || year || '}},"geometry":{{"type":"Point","coordinates":[' || lon::VARCHAR || ',' || lat::VARCHAR || ']}}}}' AS geojson FROM kept""",
    "geojson_spots": f"""{_top('both')}, kept AS (SELECT * FROM ranked WHERE rank <= 50), {_inverse('x', 'y', 'g', 'kept')},
      f AS (SELECT species, rank, '{{"type":"Feature","properties":{{"score":' || round_even(score, 3)::VARCHAR || ',"suitability":' || round_even(suitability, 3)::VARCHAR || ',"readiness":' || round_even(readiness, 3)::VARCHAR || '}},"geometry":{{"type":"Point","coordinates":[' || round_even(lon, 5)::VARCHAR || ',' || round_even(lat, 5)::VARCHAR || ']}}}}' AS j FROM g)
      SELECT species, '{{"type":"FeatureCollection","features":[' || string_agg(j, ',' ORDER BY rank) || ']}}' AS geojson, count(*)::INT AS n FROM f GROUP BY species""",
    "geojson_phases": f"""{SM}, {PHASED}, k AS (SELECT DISTINCT meteo_cell_id, split_part(meteo_cell_id, '_', 2)::BIGINT AS c, split_part(meteo_cell_id, '_', 3)::BIGINT AS r FROM phased_cells),
      kk AS (SELECT meteo_cell_id, n, (c + (n IN (1, 2))::INT) * 2200.0::DOUBLE AS px, (r + (n IN (2, 3))::INT) * 2200.0::DOUBLE AS py FROM k, range(5) t(n)), {_inverse('px', 'py', 'g', 'kk')},
      ring AS (SELECT meteo_cell_id, string_agg('[' || round_even(lon, 5)::VARCHAR || ',' || round_even(lat, 5)::VARCHAR || ']', ',' ORDER BY n) AS ring FROM g GROUP BY 1)
      SELECT species, meteo_cell_id, '{{"type":"Feature","properties":{{"state":"' || state || '","readiness":' || round_even(readiness, 3)::VARCHAR || ',"charge":' || round_even(charge, 3)::VARCHAR || ',"dst":' || dst || coalesce(',"eta":' || eta, '') || coalesce(',"days_past":' || days_past, '')
        || '}},"geometry":{{"type":"Polygon","coordinates":[[' || ring || ']]}}}}' AS geojson FROM phased_cells JOIN ring USING (meteo_cell_id)""",
    "soil_extent": f"""WITH {CELLS}, {_inverse('x', 'y', 'g', 'cells')}, b AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM g),
      t0 AS (SELECT radians(lat) AS t, pi() * sin(radians(lat)) AS goal, lon FROM (SELECT unnest([a0, a0, a1, a1]) AS lat, unnest([o0, o1, o0, o1]) AS lon FROM b)),
      """ + ", ".join(f"t{n + 1} AS (SELECT t - (2 * t + sin(2 * t) - goal) / (2 + 2 * cos(2 * t)) AS t, goal, lon FROM t{n})" for n in range(8)) + """,
      h AS (SELECT 6378137.0 * (radians(30.0) + 2 * sqrt(2.0) / pi() * radians(lon - 30.0) * cos(t)) AS hx, 6378137.0 * (sqrt(2.0) * sin(t) - 0.0528035274542) AS hy FROM t8)
      SELECT round(min(hx) - 3000, 1) AS x0, round(min(hy) - 3000, 1) AS y0, round(max(hx) + 3000, 1) AS x1, round(max(hy) + 3000, 1) AS y1 FROM h""",
    "regrid_nearest": f"WITH {CELLS}, {PIXELS}, {TARGETS} SELECT cell_key, round(value, 6) AS value FROM targets t LEFT JOIN pixels p ON p.tile = t.tile AND p.row = floor(fy) AND p.col = floor(fx)",
    "regrid_bilinear": f"""WITH {CELLS}, {PIXELS}, {TARGETS}, w AS (SELECT t.cell_key, value, (1 - abs(p.row + 0.5 - fy)) * (1 - abs(p.col + 0.5 - fx)) AS w FROM targets t JOIN pixels p ON p.tile = t.tile
        AND p.row IN (floor(fy - 0.5), floor(fy - 0.5) + 1) AND p.col IN (floor(fx - 0.5), floor(fx - 0.5) + 1))
      SELECT cell_key, round(sum(w * value) / sum(w), 5) AS value FROM w GROUP BY 1""",
    "observations_clean": f"WITH {OBS} SELECT id, species, phase, is_blank, 1 AS id_verified, round(weight_g, 4) AS weight_g, error FROM cleaned",
    "observation_cells": f"WITH {OBS} SELECT id, CASE WHEN x IS NOT NULL THEN 's100_' || floor(x / 100.0)::BIGINT || '_' || floor(y / 100.0)::BIGINT END AS static_cell_id, CASE WHEN x IS NOT NULL THEN {WCELL} END AS meteo_cell_id FROM cleaned",
    "observation_pins": f"WITH {OBS} SELECT id, species, phase, round(weight_g, 4) AS weight_g, is_blank, photo FROM cleaned WHERE error IS NULL AND x IS NOT NULL",
    "occurrence_summary": f"WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY ts, id) AS rn FROM obs WHERE x IS NOT NULL AND species IS NOT NULL) SELECT species, count(*) AS n, min(year(ts))::INT AS first_year, max(year(ts))::INT AS last_year FROM n WHERE rn <= 1000 GROUP BY 1",
    "host_coverage": f"WITH {WEIGHT}, {CELLS} SELECT w.species, count(*) AS n_cells, round(sum(w.w), 4) AS weight FROM cells c JOIN weight w ON w.cls = c.cls GROUP BY 1",
} | {f"top_spots_{mode}": _top(mode) + _TOP for mode in ("static", "dynamic", "both")}
