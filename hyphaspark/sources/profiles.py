"""Species profiles and the forest-category crosswalk as small dimension tables.

A species is a row: adding a profile needs no code. Profiles can also be read from a folder of YAML
documents, one job over the files, with a column of validation errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The host class of each forest category code, in the order of the codes' legend.
CROSSWALK = {
    "PE": "pecceta", "PF": "pecceta_secondaria", "AB": "abetina", "LC": "larici_cembreto", "FA": "faggeta",
    "MU": "mugheta", "PS": "pineta_silvestre", "PN": "pineta_nera", "CA": "castagneto", "QV": "querceto",
    "QR": "querceto_rovere", "QC": "querco_carpineto", "OS": "orno_ostrieto", "LE": "lecceta", "AF": "acero_frassineto",
    "FR": "frassineto", "AL": "alneto", "AN": "altre_latifoglie", "LS": "latifoglie_sempreverdi", "AM": "formazione_marginale",
}
CATEGORY_CODES, HOST_CLASSES = list(CROSSWALK), list(CROSSWALK.values())
CONIFER_CLASSES = ["pecceta", "pecceta_secondaria", "abetina", "larici_cembreto", "mugheta", "pineta_silvestre", "pineta_nera"]
TROPHIC_MODES = ["mycorrhizal", "saprotrophic", "facultative"]
HABITATS = ["forest", "grassland"]

# The species profiles.
PROFILES = [
    {
        "id": "amanita_caesarea", "common_name": "ovolo", "trophic_mode": "mycorrhizal", "similar_to": ["boletus_aereus"],
        "host_genera": {"castagneto": 1.0, "querceto": 0.7, "querceto_rovere": 0.7, "lecceta": 0.7, "querco_carpineto": 0.58, "latifoglie_sempreverdi": 0.55, "orno_ostrieto": 0.4, "acero_frassineto": 0.4, "formazione_marginale": 0.4, "frassineto": 0.2, "alneto": 0.12, "altre_latifoglie": 0.12},
        "static_envelope": {"elevation_m": {"min": 200, "opt": [300, 700], "max": 900}, "aspect": "warm", "slope_deg": {"opt": [3, 25]}, "soil_ph": "tolerant", "drainage": "well_drained"},
        "phenology_months": [7, 8, 9],
        "dynamic_triggers": {"rain_window_days": 12, "cumulative_rain_mm": 35, "thermal_shock_c": 4, "soil_temp_c": {"min": 15, "max": 26}, "lag_days": {"opt": [10, 16]}, "moisture_floor": 0.18},
    },
    {
        "id": "boletus_aereus", "common_name": "porcino nero", "trophic_mode": "mycorrhizal", "similar_to": ["boletus_aestivalis", "amanita_caesarea"],
        "host_genera": {"querceto": 1.0, "querceto_rovere": 1.0, "lecceta": 1.0, "querco_carpineto": 0.72, "castagneto": 0.7, "latifoglie_sempreverdi": 0.65, "orno_ostrieto": 0.3, "acero_frassineto": 0.3, "formazione_marginale": 0.3, "frassineto": 0.15, "alneto": 0.09, "altre_latifoglie": 0.09},
        "static_envelope": {"elevation_m": {"min": 100, "opt": [200, 600], "max": 800}, "aspect": "warm", "slope_deg": {"opt": [5, 25]}, "soil_ph": "acidic", "drainage": "well_drained"},
        "phenology_months": [6, 7, 8, 9, 10],
        "dynamic_triggers": {"rain_window_days": 15, "cumulative_rain_mm": 40, "thermal_shock_c": 5, "soil_temp_c": {"min": 12, "max": 22}, "lag_days": {"opt": [10, 18]}, "moisture_floor": 0.20},
    },
    {
        "id": "boletus_aestivalis", "common_name": "estatino", "trophic_mode": "mycorrhizal", "similar_to": ["boletus_aereus", "boletus_edulis"],
        "host_genera": {"castagneto": 1.0, "querceto": 0.8, "querceto_rovere": 0.8, "lecceta": 0.8, "faggeta": 0.6, "querco_carpineto": 0.6, "latifoglie_sempreverdi": 0.55, "orno_ostrieto": 0.3, "acero_frassineto": 0.3, "formazione_marginale": 0.3, "pecceta": 0.2, "pecceta_secondaria": 0.2, "abetina": 0.2, "frassineto": 0.15, "alneto": 0.09, "altre_latifoglie": 0.09},
        "static_envelope": {"elevation_m": {"min": 200, "opt": [300, 1000], "max": 1500}, "aspect": "neutral", "slope_deg": {"opt": [5, 30]}, "soil_ph": "tolerant", "drainage": "well_drained"},
        "phenology_months": [5, 6, 7, 8, 9],
        "dynamic_triggers": {"rain_window_days": 15, "cumulative_rain_mm": 35, "thermal_shock_c": 4, "soil_temp_c": {"min": 13, "max": 24}, "lag_days": {"opt": [8, 15]}, "moisture_floor": 0.18},
    },
    {
        "id": "boletus_edulis", "common_name": "porcino", "trophic_mode": "mycorrhizal", "similar_to": ["boletus_pinophilus", "boletus_aestivalis"],
        "host_genera": {"pecceta": 1.0, "pecceta_secondaria": 1.0, "abetina": 1.0, "faggeta": 0.9, "castagneto": 0.7, "querceto": 0.4, "querceto_rovere": 0.4, "lecceta": 0.4, "querco_carpineto": 0.24, "latifoglie_sempreverdi": 0.2},
        "static_envelope": {"elevation_m": {"min": 500, "opt": [800, 1600], "max": 2000}, "aspect": "cool", "slope_deg": {"opt": [5, 30]}, "soil_ph": "acidic", "drainage": "well_drained"},
        "phenology_months": [8, 9, 10, 11],
        "dynamic_triggers": {"rain_window_days": 15, "cumulative_rain_mm": 45, "thermal_shock_c": 5, "soil_temp_c": {"min": 8, "max": 18}, "lag_days": {"opt": [10, 20]}, "moisture_floor": 0.22},
    },
    {
        "id": "boletus_pinophilus", "common_name": "porcino rosso", "trophic_mode": "mycorrhizal", "similar_to": ["boletus_edulis"],
        "host_genera": {"pineta_silvestre": 1.0, "pineta_nera": 1.0, "pecceta": 0.9, "pecceta_secondaria": 0.9, "abetina": 0.9, "mugheta": 0.8, "faggeta": 0.6, "larici_cembreto": 0.4, "castagneto": 0.4},
        "static_envelope": {"elevation_m": {"min": 1000, "opt": [1200, 1800], "max": 2000}, "aspect": "cool", "slope_deg": {"opt": [10, 35]}, "soil_ph": "acidic", "drainage": "well_drained"},
        "phenology_months": [4, 5, 6, 9, 10],
        "dynamic_triggers": {"rain_window_days": 12, "cumulative_rain_mm": 40, "thermal_shock_c": 6, "soil_temp_c": {"min": 7, "max": 16}, "lag_days": {"opt": [12, 20]}, "moisture_floor": 0.22},
    },
    {
        "id": "cantharellus_cibarius", "common_name": "finferlo", "trophic_mode": "mycorrhizal", "similar_to": [],
        "host_genera": {"faggeta": 0.9, "castagneto": 0.8, "querceto": 0.8, "querceto_rovere": 0.8, "lecceta": 0.8, "pecceta": 0.7, "pecceta_secondaria": 0.7, "abetina": 0.7, "pineta_silvestre": 0.6, "pineta_nera": 0.6, "mugheta": 0.48, "querco_carpineto": 0.48, "latifoglie_sempreverdi": 0.4, "larici_cembreto": 0.24},
        "static_envelope": {"elevation_m": {"min": 300, "opt": [600, 1600], "max": 2000}, "aspect": "cool", "slope_deg": {"opt": [5, 30]}, "soil_ph": "acidic", "drainage": "moist"},
        "phenology_months": [5, 6, 7, 8, 9, 10],
        "dynamic_triggers": {"rain_window_days": 10, "cumulative_rain_mm": 30, "thermal_shock_c": 4, "soil_temp_c": {"min": 8, "max": 20}, "lag_days": {"opt": [5, 12]}, "moisture_floor": 0.25},
    },
]

_RANGE = "struct<min: double, opt: array<double>, max: double>"
SCHEMA = (
    "species string, common_name string, trophic_mode string, habitat string, similar_to array<string>, host_genera map<string, double>, "
    f"static_envelope struct<elevation_m: {_RANGE}, slope_deg: {_RANGE}, aspect: string, soil_ph: string, drainage: string>, "
    "phenology_months array<int>, "
    f"dynamic_triggers struct<rain_window_days: int, cumulative_rain_mm: double, thermal_shock_c: double, soil_temp_c: struct<min: double, max: double>, lag_days: {_RANGE}, moisture_floor: double>"
)


def _number(x):
    return None if x is None else float(x)


def _range(d: dict | None):
    return None if d is None else (_number(d.get("min")), [float(x) for x in d["opt"]] if d.get("opt") else None, _number(d.get("max")))


def as_row(p: dict) -> tuple:
    """One profile document as a row of ``SCHEMA``, defaults filled in."""
    env, dyn = p.get("static_envelope") or {}, p.get("dynamic_triggers") or {}
    temp = dyn.get("soil_temp_c") or {}
    return (
        p["id"], p.get("common_name") or p["id"], p.get("trophic_mode") or "mycorrhizal", p.get("habitat") or "forest", list(p.get("similar_to") or []),
        {k: float(v) for k, v in (p.get("host_genera") or {}).items()},
        (_range(env.get("elevation_m")), _range(env.get("slope_deg")), env.get("aspect"), env.get("soil_ph"), env.get("drainage")),
        [int(m) for m in p.get("phenology_months") or []],
        (dyn.get("rain_window_days"), _number(dyn.get("cumulative_rain_mm")), _number(dyn.get("thermal_shock_c")), (_number(temp.get("min")), _number(temp.get("max"))), _range(dyn.get("lag_days")), _number(dyn.get("moisture_floor"))),
    )


def profiles(spark: SparkSession, documents: list[dict] | None = None, only: list[str] | None = None) -> DataFrame:
    """The profile table: a handful of rows, small enough to broadcast wherever it is joined."""
    rows = {p["id"]: as_row(p) for p in (PROFILES if documents is None else documents)}  # the last of an id wins
    table = spark.createDataFrame([rows[k] for k in sorted(rows)], SCHEMA)
    return table if only is None else table.where(F.col("species").isin(only))


def profiles_from_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, the profile columns and parse_error, from YAML documents; empty ones are skipped and the
    last file of an id (by name) wins."""
    import yaml

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, text in zip(frame["file"], frame["value"], strict=True):
                try:
                    doc = yaml.safe_load(text)
                    if doc:
                        out.append((name, pd.Series([as_row(doc.get("species", doc))], dtype=object)[0], None))
                except Exception as e:  # a bad document becomes an error row
                    out.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"file": [o[0] for o in out], "profile": [_as_dict(o[1]) for o in out], "parse_error": [o[2] for o in out]})

    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    parsed = files.mapInPandas(parse, f"file string, profile struct<{SCHEMA.replace(' string', ': string', 4).replace('similar_to array', 'similar_to: array').replace('host_genera map', 'host_genera: map').replace('static_envelope struct', 'static_envelope: struct').replace('phenology_months array', 'phenology_months: array').replace('dynamic_triggers struct', 'dynamic_triggers: struct')}>, parse_error string")
    latest = parsed.withColumn("last", F.max("file").over(_by_species())).where("profile IS NULL OR file = last")
    return latest.select("file", "profile.*", "parse_error")


def _by_species():
    from pyspark.sql import Window

    return Window.partitionBy("profile.species")


def _as_dict(row: tuple | None):
    if row is None:
        return None
    r = lambda t: None if t is None else {"min": t[0], "opt": t[1], "max": t[2]}
    env, dyn = row[6], row[8]
    return {
        "species": row[0], "common_name": row[1], "trophic_mode": row[2], "habitat": row[3], "similar_to": row[4], "host_genera": row[5],
        "static_envelope": {"elevation_m": r(env[0]), "slope_deg": r(env[1]), "aspect": env[2], "soil_ph": env[3], "drainage": env[4]},
        "phenology_months": row[7],
        "dynamic_triggers": {"rain_window_days": dyn[0], "cumulative_rain_mm": dyn[1], "thermal_shock_c": dyn[2], "soil_temp_c": {"min": dyn[3][0], "max": dyn[3][1]}, "lag_days": r(dyn[4]), "moisture_floor": dyn[5]},
    }


def crosswalk(spark: SparkSession) -> DataFrame:
    """code -> host map: each forest category is a host class of its own."""
    return spark.createDataFrame([(c, {h: 1.0}) for c, h in zip(CATEGORY_CODES, HOST_CLASSES, strict=True)], "code string, host map<string, double>")


def errors() -> Column:
    """What is wrong with a profile row (an empty array: nothing)."""
    unknown = F.array_except(F.map_keys("host_genera"), F.array(*[F.lit(c) for c in HOST_CLASSES]))
    return F.array_compact(
        F.array(
            F.when(~F.col("trophic_mode").isin(TROPHIC_MODES), F.concat(F.lit("trophic_mode: "), "trophic_mode")),
            F.when(~F.col("habitat").isin(HABITATS), F.concat(F.lit("habitat: "), "habitat")),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown hosts: "), F.array_join(F.array_sort(unknown), ","))),
            F.when(F.exists("phenology_months", lambda m: (m < 1) | (m > 12)), F.lit("month outside 1..12")),
            F.when((F.col("trophic_mode") == "mycorrhizal") & (F.size("host_genera") == 0), F.lit("mycorrhizal without hosts")),
        )
    )


def submission_errors(file_col: str = "file") -> Column:
    """Rules for a submitted document: file name, id equal to its stem, parseable."""
    return F.array_compact(
        F.array(
            F.when(~F.col(file_col).rlike(r"^[a-z0-9_]+\.yaml$"), F.lit("file name")),
            F.when(F.col("species") != F.regexp_replace(file_col, r"\.yaml$", ""), F.lit("id differs from file name")),
            F.when(F.col("parse_error").isNotNull(), F.col("parse_error")),
        )
    )


def scientific_name(species: Column) -> Column:
    words = F.replace(species, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words))))
