"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through rounds of random signs and a fast Hadamard transform (a pseudo-rotation); a hash is
the signed axis a vector is nearest to, and a bucket is given by ``functions`` hashes, each taken after one
more round. A query looks into ``probes`` buckets of each table, those whose axes it is nearest to in all, best
first over the hashes together. All candidates are ranked by their exact cosine on the original vectors, in double
precision.

Vectors are hashed relative to the mean of all unit vectors, for vectors that share a direction would crowd into its buckets.
How many hashes, tables and probes it takes follows from the data (``plan``): a bounded sample of ``SAMPLE``
queries is compared with every row once, which gives the cosines that neighbours have in this table (relative to the mean), and pairs of
vectors with such cosines are put through the very hashes. How many rows the probes of these queries meet is counted
over all rows (``_met``), so uneven buckets are planned for as they are. Of the settings that find ``WANTED`` of the pairs the one
with the least work is taken: vectors without structure need many probes of few hashes, clustered or very many
ones few probes of more hashes. Where no setting finds as many, as for wide vectors without any structure, queries
are compared with all rows, in blocks; so are queries that find fewer than ``k`` candidates.

Equal vectors are one class with its ``k + 1`` smallest ids (no query can need more of them), so a group of
copies of any size is hashed and compared once. Buckets of more than ``BLOCK`` classes or queries are cut on
both sides, and a block only returns each query's best, so no table of candidate pairs is ever made.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
without an id; shorter vectors count as padded with zeros. Repeated rows count once. Rows with one id are one vector
to its own query: it never finds its id; of several vectors under a query's id the smallest (by its bytes) asks.
Equal cosines go to the smaller id. If fewer than ``k`` other vectors exist, all are returned; an empty table gives an
empty result. Only the two named columns are read; there is no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK, ROUNDS, SAMPLE, WANTED, PAIRS = 4096, 3, 128, 0.95, 64
TABLES, FUNCTIONS, PROBES = (8, 16), (1, 2, 3), (1, 2, 3, 5, 8, 12, 18, 27, 40, 60)
TRIED = 2  # tables in which the rows that probes meet are counted
COPY = 50  # comparisons that weigh as much as sending a vector to a block


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array<float> if the column is one, else array<double>) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two wide), scaled to keep lengths; its axes come in an
    order of their own. A few products with small Hadamard matrices make one transform."""
    n, width = x.shape
    left = width
    while left > 1:
        r = min(left, 16)
        small = np.array([[(-1) ** (i & j).bit_count() for i in range(r)] for j in range(r)], x.dtype)
        x = (x.reshape(-1, r) @ small).reshape(n, width // r, r).swapaxes(1, 2).reshape(n, width)
        left //= r
    return x / np.sqrt(x.dtype.type(width))


def _rotations(units: np.ndarray, tables: int, functions: int, seed: int):
    """For each table the rotated vectors of each hash."""
    rng = np.random.default_rng(seed)
    for _ in range(tables):
        x, out = units, []
        for k in range(ROUNDS + functions - 1):
            x = hadamard(x * rng.choice(np.array([-1, 1], units.dtype), units.shape[1]))
            if k >= ROUNDS - 1:
                out.append(x)
        yield out


def _units(x: np.ndarray, mean: np.ndarray | float = 0.0) -> np.ndarray:
    """Unit vectors, or their directions from the ``mean`` of such."""
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _bucket(rotated: list[np.ndarray]) -> np.ndarray:
    """The bucket of each vector: its signed axis (axis + width if negative) under every hash."""
    out = np.zeros(len(rotated[0]), np.int64)
    for x in rotated:
        at = np.abs(x).argmax(1)
        out = out * (2 * x.shape[1]) + at + x.shape[1] * (x[np.arange(len(x)), at] < 0)
    return out


def _probed(rotated: list[np.ndarray], probes: int) -> np.ndarray:
    """The ``probes`` buckets of each query, best first: those with the least sum of squared gaps between the
    nearest axis' coordinate and the bucket's, over all hashes. Columns are probes; -1 where there are no more."""
    width = rotated[0].shape[1]
    bucket, cost = np.zeros((len(rotated[0]), 1), np.int64), np.zeros((len(rotated[0]), 1), np.float32)
    for x in rotated:
        both = np.concatenate([x, -x], 1)
        axes = np.argsort(-both, axis=1, kind="stable")[:, : min(probes, 2 * width)]
        own = np.take_along_axis(both, axes, 1)
        own = (own[:, :1] - own) ** 2
        # of two ascending lists only places i, j with (i + 1) (j + 1) <= probes can be among the least sums
        i, j = (p.ravel() for p in np.indices((cost.shape[1], own.shape[1])))
        i, j = (p[(i + 1) * (j + 1) <= probes] for p in (i, j))
        cost, bucket = cost[:, i] + own[:, j], bucket[:, i] * (2 * width) + axes[:, j]
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        cost, bucket = np.take_along_axis(cost, best, 1), np.take_along_axis(bucket, best, 1)
    return np.pad(bucket, ((0, 0), (0, probes - bucket.shape[1])), constant_values=-1)


def _found(cosines: np.ndarray, width: int, dims: int, functions: int, tables: int, seed: int) -> np.ndarray:
    """For each table count and number of probes in ``PROBES`` the share of pairs of vectors at these
    cosines that meet (tables x PROBES)."""
    rng = np.random.default_rng(seed + 1)
    a, b = rng.normal(size=(2, len(cosines) * PAIRS, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    c = np.repeat(cosines, PAIRS)[:, None]
    b = c * a + np.sqrt(np.maximum(0, 1 - c * c)) * b
    both = np.zeros((2 * len(a), width), np.float32)
    both[:, :dims] = np.concatenate([a, b])
    met = np.zeros((len(a), len(PROBES)), bool)
    out = []
    for rotated in _rotations(both, tables, functions, seed):
        asked = _probed([x[: len(a)] for x in rotated], PROBES[-1])
        hit = asked == _bucket([x[len(a) :] for x in rotated])[:, None]
        met |= np.stack([hit[:, :p].any(1) for p in PROBES], 1)
        out.append(met.mean(0))
    return np.array(out)


def plan(cosines: np.ndarray, width: int, dims: int, rows: int, queries: int, met: np.ndarray | None = None, seed: int = 11) -> dict | None:
    """The setting with the least work that finds ``WANTED`` of neighbours at such cosines: functions,
    tables, probes, found (the share of pairs found) and scanned (what a query is compared with, as a share of the
    rows; less than 1). ``met`` has the share of the rows that a table's probes meet (functions x PROBES); without it buckets count as
    even. None if no setting does."""
    some = np.quantile(cosines, (np.arange(12) + 0.5) / 12)
    best, least = None, np.inf
    for f, functions in enumerate(FUNCTIONS):
        share = _found(some, width, dims, functions, max(TABLES), seed)
        if share[-1, -1] < WANTED:
            break  # more hashes find less
        for tables, (i, probes) in product(TABLES, enumerate(PROBES)):
            scanned = tables * (probes / (2 * width) ** functions if met is None else float(met[f, i]))
            work = rows * scanned + COPY * tables * (probes + rows / max(1, queries) / 64)
            if share[tables - 1, i] >= WANTED and scanned < 1 and work < least:
                least, best = work, {"functions": functions, "tables": tables, "probes": probes, "found": float(share[tables - 1, i]), "scanned": scanned}
    return best


def _packer(width: int, kind: str):
    """vec_id and the vector's bytes, padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((len(column), width), kind)
            x[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            x += 0.0  # one zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "vec"])

    return run


def _vectors(column, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), kind).reshape(-1, width).astype(np.float64)


def _hasher(width: int, kind: str, mean: np.ndarray, functions: int, tables: int, probes: int, seed: int, with_vec: bool = True):
    """(tab, bucket, id, vec) rows: one a table, or one a probe for queries (``probes`` > 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if part.num_rows == 0:
                    continue
                units = _units(_vectors(part.column(1), width, kind), mean)
                for t, rotated in enumerate(_rotations(units, tables, functions, seed)):
                    for bucket in _probed(rotated, probes).T if probes else [_bucket(rotated)]:
                        there = pa.array(bucket >= 0)
                        cols = [pa.array(np.full(len(units), t, np.int32)), pa.array(bucket), part.column(0), part.column(1) if with_vec else pa.nulls(len(units), pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["tab", "bucket", "id", "vec"]).filter(there)

    return run


def _best_of(q: np.ndarray, q_id: np.ndarray, r: np.ndarray, r_id: np.ndarray, k: int):
    """Each query's k nearest rows: ids of both and scores."""
    out: list[tuple[np.ndarray, ...]] = []
    order = np.argsort(r_id, kind="stable")
    r_id, r = r_id[order], r[order]
    q_len, r_len = np.sqrt((q * q).sum(1)), np.sqrt((r * r).sum(1))
    r_unit = (r / r_len[:, None]).T
    for lo in range(0, len(q), 256):
        near = (q[lo : lo + 256] / q_len[lo : lo + 256, None]) @ r_unit
        keep = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - keep, axis=1)[:, near.shape[1] - keep]
        for i, j in enumerate(near):
            at = np.flatnonzero(j >= least[i] - 1e-9)
            # the product's rounding depends on a row's place, this sum's does not: equal vectors tie
            exact = (r[at] * q[lo + i]).sum(1) / (r_len[at] * q_len[lo + i])
            top = np.lexsort((r_id[at], -exact))[:k]
            out.append((np.full(len(top), q_id[lo + i]), r_id[at][top], exact[top]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _ranker(width: int, kind: str, k: int):
    """Each query's k nearest rows of one block."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            cols = _best_of(_vectors(queries["vec"], width, kind), queries["id"].to_numpy(), _vectors(rows["vec"], width, kind), rows["id"].to_numpy(), k)
        return pa.table(dict(zip(("q", "id", "score"), map(pa.array, cols), strict=True)), schema=_BEST)

    return run


_BEST = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
_FOUND = "q long, id long, score double"
_HASHED = "tab int, bucket long, id long, vec binary"


def _meet(queries: DataFrame, rows: DataFrame, keys: list[str], width: int, kind: str, k: int) -> DataFrame:
    """The k best of every block; a key's queries (qs) and rows (rs) are cut into as many parts as they need."""
    keys = [*keys, "rs", "qs"]
    met = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_ranker(width, kind, k), _FOUND)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return met.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _cut(df: DataFrame, own: str, other: str, parts: Column, others: Column) -> DataFrame:
    """Rows with their own part and a copy for each part of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))


def _mean(classes: DataFrame, width: int, kind: str) -> np.ndarray:
    """The mean of the classes' unit vectors, to six decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = _vectors(batch.column(0).slice(lo, BLOCK), width, kind)
                x = x / np.abs(x).max(1, keepdims=True)
                total += (x / np.linalg.norm(x, axis=1, keepdims=True)).sum(0)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total), pa.array(np.full(width, n))], ["at", "total", "n"])

    made = classes.select("vec").mapInArrow(run, "at int, total double, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = np.zeros(width)
    out[made["at"].to_numpy()] = np.round(made["total"].to_numpy() / np.maximum(made["n"].to_numpy(), 1), 6)
    return out


def _sampled(classes: DataFrame, q: np.ndarray, ids: np.ndarray, mean: np.ndarray, width: int, kind: str, k: int) -> np.ndarray:
    """Cosines, relative to the mean, of the k nearest classes of some queries, each compared with every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _units(q, mean).astype(np.float64)
        place = {i: n for n, i in enumerate(ids.tolist())}
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                if part.num_rows:
                    r, r_id = _vectors(part.column(1), width, kind), part.column(0).to_numpy()
                    cols = _best_of(q, ids, r, r_id, k + 1)
                    at = np.argsort(r_id, kind="stable")[np.searchsorted(np.sort(r_id), cols[1])]
                    own = (near[[place[i] for i in cols[0].tolist()]] * _units(r, mean)[at]).sum(1)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (*cols, own))], ["q", "id", "score", "own"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = classes.select("id", "vec").mapInArrow(run, f"{_FOUND}, own double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return best.where("id <> q").select("own").toArrow()["own"].to_numpy()


def _met(classes: DataFrame, q: np.ndarray, mean: np.ndarray, width: int, kind: str, rows: int, seed: int) -> np.ndarray:
    """The share of the classes that the probes of some queries meet in a table, for each number of hashes and of probes
    (functions x PROBES): counted over all classes in ``TRIED`` tables, of which a task sends one number a bucket that is asked for."""
    asked = {}  # (functions, table): buckets by query and probe, the distinct ones, and the places of the first among these
    for f in FUNCTIONS:
        for t, rotated in enumerate(_rotations(_units(q, mean), TRIED, f, seed)):
            buckets = _probed(rotated, PROBES[-1])
            asked[f, t] = (buckets, *np.unique(buckets, return_inverse=True))
    starts = np.cumsum([0, *(len(v[1]) for v in asked.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(starts[-1], np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                units = _units(_vectors(batch.column(0).slice(lo, 1024), width, kind), mean)
                for f in FUNCTIONS if len(units) else ():
                    for t, rotated in enumerate(_rotations(units, TRIED, f, seed)):
                        distinct = asked[f, t][1]
                        bucket = _bucket(rotated)
                        at = np.minimum(np.searchsorted(distinct, bucket), len(distinct) - 1)
                        first = starts[list(asked).index((f, t))]
                        counts[first : first + len(distinct)] += np.bincount(at[distinct[at] == bucket], minlength=len(distinct))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["at", "n"])

    made = classes.select("vec").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(starts[-1], np.int64)
    counts[made["at"].to_numpy()] = made["n"].to_numpy()
    out = np.zeros((len(FUNCTIONS), len(PROBES)))
    for (f, _), first, (buckets, distinct, at) in zip(asked, starts, asked.values(), strict=False):
        held = np.where(buckets >= 0, counts[first : first + len(distinct)][at.reshape(buckets.shape)], 0).cumsum(1)
        out[FUNCTIONS.index(f)] += held[:, [p - 1 for p in PROBES]].mean(0) / TRIED / max(1, rows)
    return out


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11, setting: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row where ``is_query`` (a
    condition on ``vec_id``) holds, among all other rows. ``setting`` (functions, tables, probes) replaces the plan."""
    vectors = usable(df, id_col, vec_col)
    kind = "<f4" if vectors.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"
    dims = vectors.agg(F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("n")).first()["n"]
    width = 1 << max(0, dims - 1).bit_length()
    packed = vectors.mapInArrow(_packer(width, kind), "vec_id long, vec binary")
    # a class of equal vectors: its smallest id, and the k + 1 smallest ones
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    some = packed.distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    classes = shared.stage(some.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids"), "classes")
    asking = packed.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    askers = asking.groupBy("vec").agg(F.min("vec_id").alias("id"))
    queries = shared.stage(askers.select("id", "vec"), "queries")
    asking = shared.stage(asking.join(queries, "vec").select("vec_id", F.col("id").alias("q")), "asking")
    n, n_queries = classes.count(), queries.count()
    mean = _mean(classes, width, kind)
    if setting is None and n_queries:
        sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        q, q_ids = _vectors(sample["vec"], width, kind), sample["id"].to_numpy()
        cosines = _sampled(classes, q, q_ids, mean, width, kind, k)
        setting = plan(cosines, width, dims, n, n_queries, _met(classes, q, mean, width, kind, n, seed), seed) if len(cosines) else None
    if setting:
        hashed = lambda d, probes, vec=True: d.select("id", "vec").mapInArrow(_hasher(width, kind, mean, setting["functions"], setting["tables"], probes, seed, vec), _HASHED)
        # Buckets of more than a block's rows or queries are cut.
        sizes = lambda d, c: d.groupBy("tab", "bucket").count().where(F.col("count") > BLOCK).select("tab", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias(c))
        large = sizes(hashed(classes, 0, False), "r_parts").join(sizes(hashed(queries, setting["probes"], False), "q_parts"), ["tab", "bucket"], "full")
        large = shared.stage(large.na.fill(1), "buckets")
        r, q = F.coalesce("r_parts", F.lit(1)), F.coalesce("q_parts", F.lit(1))
        rows = _cut(hashed(classes, 0).join(large, ["tab", "bucket"], "left"), "rs", "qs", r, q)
        asked = _cut(hashed(queries, setting["probes"]).join(large, ["tab", "bucket"], "left"), "qs", "rs", q, r)
        columns = ["tab", "bucket", "rs", "qs", "id", "vec"]
        found = shared.stage(_meet(asked.select(*columns), rows.select(*columns), ["tab", "bucket"], width, kind, k + 1), "found")
        shared.discard(large)
        counts = found.groupBy("q").count().where(F.col("count") >= min(k + 1, n))
        short = shared.stage(queries.join(counts, F.col("id") == F.col("q"), "left_anti"), "short")
    else:
        found, short = classes.sparkSession.createDataFrame([], _FOUND), queries
    if short.take(1):  # compared with all, in blocks
        r, q = (F.lit(m // BLOCK + 1) for m in (n, short.count()))
        exact = _meet(_cut(short, "qs", "rs", q, r), _cut(classes.select("id", "vec"), "rs", "qs", r, q), [], width, kind, k + 1)
        found = found.join(short, F.col("q") == short["id"], "left_anti").unionByName(exact)
    each = found.join(classes.select("id", "ids"), "id").select("q", F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x.alias("id"))).alias("near"))
    lists = each.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)
    out = asking.join(lists, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
