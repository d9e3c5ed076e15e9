"""Helpers shared by the training-data operators: staging folders and vectorised word scanning.

``stage`` cuts lineage by writing Parquet to the folder the cluster names in ``spark.checkpoint.dir``;
``discard`` removes such a table once what was made of it is written. A folder of our own is used only where that
setting is absent and the master is local.

The word scanner works on the UTF-8 buffer of an Arrow string column, so a slice of many texts is
split into words and hashed with a handful of numpy passes and no per-word Python objects. Word hashes
mix 8-byte lanes of the word with a strong finaliser; spans of more than ``LANES`` lanes are hashed one
by one by XXH3, so no structure of a long text makes two different spans alike by design.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
LANES = 4


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stage(df: DataFrame, name: str = "stage", *used: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files. The staged
    tables ``used``, which nothing reads any more, are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._staged_at = path
    for scope in _SCOPES:
        scope.append(made)
    discard(*used)
    return made


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def stage_alone(*used: DataFrame):
    """Gives a function like ``stage``; when the block ends, the last table it made is the only one that is left of all that were staged
    within the block, and the tables ``used`` are gone too."""
    scope: list[DataFrame] = []
    _SCOPES.append(scope)
    try:
        yield stage
    finally:
        _SCOPES.remove(scope)
    discard(*scope[:-1], *used)


def staged_as(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, which is made of the staged ``source`` alone, counts as its table."""
    df._staged_at = source._staged_at
    return df


def discard(*staged: DataFrame) -> None:
    """Removes the files of staged tables."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keep_rows(df: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows whose texts ``decide`` keeps, with all their columns and without a shuffle. ``decide``
    takes a string array and returns a mask."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


# --- words over Arrow buffers -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a lane


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser; ``salt`` gives independent functions."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def strings(column: pa.Array) -> pa.Array:
    """The column as a plain string array, null as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string array without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of rows with at most ``most`` bytes, one row at least."""
    data, offsets = buffers(strings(column))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """Starts and ends of the words, and the word offsets of each text (n + 1)."""
    word = ~space[data]
    before = np.empty_like(word)
    before[1:], before[:1] = word[:-1], False
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[:-1], after[-1:] = word[1:], False
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
    size = ends - starts
    out = mix(size.astype(np.uint64), 21)
    for k in range(LANES):
        at = np.flatnonzero(size > 8 * k) if k else slice(None)
        if k and len(at) == 0:
            break
        lane = lanes[starts[at] + 8 * k] & _KEEP[np.clip(size[at] - 8 * k, 0, 8)]
        with np.errstate(over="ignore"):
            out[at] = mix(out[at] * _R + lane, k + 22)
    raw = memoryview(padded)
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def counts_within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True values of each run offsets[i]..offsets[i + 1]."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    if len(flags):
        out[sizes > 0] = np.add.reduceat(flags.view(np.uint8), offsets[:-1][sizes > 0], dtype=np.int64)
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries (len - n + 1)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * _R + hashes[j : j + m]
        return mix(out, n)
