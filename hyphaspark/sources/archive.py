"""Archives in versions: a manifest names the folder that holds each date.

A write puts the new rows of its dates into a folder of its own and touches nothing else. Then one small file, the next manifest, is created under its
final name, and from then on readers see all of the new dates; whoever dies before that leaves the archive as it
was. Two writers cannot create the same manifest, so the second one fails and changes nothing. Folders that neither the present nor the last
manifest names are removed after the switch, those of a broken write with the next one that succeeds; a reader
that planned before a switch can so finish."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at(path))) if fs.exists(at(path)) else []


def _manifest(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    fs, at = _fs(spark, path)
    stream = fs.open(at(f"{path}/manifests/{name}"))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the manifests in order; one that is being written ends otherwise."""
    return [x for x in _names(spark, f"{path}/manifests") if x.endswith(".json")]


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the version (0: none yet) and the folder of each date."""
    names = _manifests(spark, path)
    return (int(names[-1][:-5]), _manifest(spark, path, names[-1])) if names else (0, {})


def read(spark: SparkSession, path: str, schema, dates: Iterable[str] | None = None) -> DataFrame:
    """The archive, or its rows of some dates (YYYY-MM-DD), of which alone files are listed; an empty table where
    there is none yet."""
    folders = current(spark, path)[1]
    wanted = folders if dates is None else [d for d in dates if d in folders]
    paths = [f"{path}/data/{folders[d]}/day={d}" for d in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def switch(spark: SparkSession, path: str, version: int, folders: dict[str, str]) -> None:
    """Makes ``folders`` the archive, as the given version, which must not be there yet."""
    fs, at = _fs(spark, path)
    made = at(f"{path}/manifests/{version:012d}.tmp-{uuid.uuid4().hex}")
    stream = fs.create(made, False)
    stream.write(bytearray(json.dumps(folders), "utf-8"))
    stream.close()
    name = at(f"{path}/manifests/{version:012d}.json")
    if fs.exists(name) or not fs.rename(made, name):
        fs.delete(made, False)
        raise RuntimeError(f"version {version} of {path} is there already: another writer was faster")


def overwrite_dates(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], dates: DataFrame, key: str) -> None:
    """Replaces the rows of ``dates`` (a handful, one row each) by what ``change`` makes of them."""
    schema = f"{key} string, date date, precip_mm double, soil_temp_c double, soil_moist double"
    version, folders = current(spark, path)
    days = sorted(str(r["date"]) for r in dates.collect())
    if not days:
        return
    new = change(read(spark, path, schema, days)).select(key, "date", "precip_mm", "soil_temp_c", "soil_moist")
    folder = f"v{version + 1:012d}-{uuid.uuid4().hex}"
    new.repartition("date").withColumn("day", F.col("date").cast("string")).write.partitionBy("day").parquet(f"{path}/data/{folder}")
    made = {x[4:] for x in _names(spark, f"{path}/data/{folder}") if x.startswith("day=")}
    switch(spark, path, version + 1, {d: f for d, f in folders.items() if d not in days} | dict.fromkeys(sorted(made), folder))
    clean(spark, path)


def clean(spark: SparkSession, path: str) -> None:
    """Removes what neither the last two manifests nor a later write name."""
    fs, at = _fs(spark, path)
    names = _manifests(spark, path)
    kept = [_manifest(spark, path, x) for x in names[-2:]]
    used = {f"{folder}/day={d}" for m in kept for d, folder in m.items()}
    for name in _names(spark, f"{path}/manifests"):
        if name[:12] < names[-2:][0][:12] or ".tmp-" in name and name[:12] <= names[-1][:12]:
            fs.delete(at(f"{path}/manifests/{name}"), False)
    last = f"v{int(names[-1][:-5]):012d}"
    for folder in _names(spark, f"{path}/data"):
        if folder[:13] > last:
            continue  # of a writer that is at it
        days = [x for x in _names(spark, f"{path}/data/{folder}") if x.startswith("day=")]
        if not any(f"{folder}/{x}" in used for x in days):
            fs.delete(at(f"{path}/data/{folder}"), True)
        else:
            for x in days:
                if f"{folder}/{x}" not in used:
                    fs.delete(at(f"{path}/data/{folder}/{x}"), True)
