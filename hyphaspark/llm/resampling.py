"""Target-distribution importance resampling: array-scored weights, sorted by regular sampling.

Features of a text are its runs of one to three words, hashed to ``buckets`` by CRC-32. The features of all documents
and of all target texts are counted by bucket; the logarithm of the two smoothed shares' quotient is a bucket's gain, and a
document's weight is the sum of its features' gains, looked up in one array. CRCs of runs come from continuing the
registers of the runs that are a word shorter, many words at once. Gumbel noise from a digest of the id turns the
weights into a draw without replacement: the highest scores are drawn.

Exact ranks come from parallel sorting by regular sampling (``ranked``). Each task sorts its run of keys and takes
samples at a regular stride; the samples are thinned by regular sampling once more in ``GROUPS`` tasks, and the driver
picks splitters from at most ``GROUPS`` times 8 times ``MAX_PARTS`` of them. No part then has more than one and a half times its
share of the rows. Rows are counted by part, the prefix sums of the counts are the ranks before each part, and
only the parts that hold drawn rows are exchanged, each to a task of its own, where Spark's sort merges the segments. The rest of the rows
never move.

A null text, or one without words, has no features and weight 0; a null id hashes as an empty one and comes after all
others of its score. Rows that repeat id and score share consecutive ranks, in any order; a row key keeps even many of
them apart, so they do not meet in one part. Texts are never cut: a very long one is a slice of its own and
takes about 60 bytes of memory a word. Columns other than id and text are not read. An empty table gives
an empty result; an empty target has equal shares in all buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
PART_ROWS, MAX_PARTS, GROUPS = 1 << 13, 1 << 11, 64
LONG = 32  # bytes of a word that are hashed many words at once
LAST = (1 << 63) - 1  # the place of a null id

_OTHER = np.ones(256, bool)
_OTHER[0x30:0x3A] = _OTHER[0x61:0x7B] = _OTHER[0x80:] = False


def _crc_table() -> np.ndarray:
    """The register after each byte value, for the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def _step(register: np.ndarray, byte) -> np.ndarray:
    return _CRC[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


class Words:
    """The words of a slice, longest first, so that the words with a k-th byte are a prefix."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        self.order = np.argsort(-size, kind="stable")
        self.data, self.starts = data, starts[self.order]
        at_least = len(size) - np.searchsorted(np.sort(size), np.arange(1, min(LONG, int(size.max(initial=0))) + 1))
        self.counts = at_least.tolist()
        self.long = [(i, data[starts[i] + LONG : ends[i]].tobytes()) for i in np.flatnonzero(size > LONG).tolist()]

    def extend(self, registers: np.ndarray) -> np.ndarray:
        """Each word's register after the word, from the one before it."""
        out = registers[self.order]
        for k, n in enumerate(self.counts):
            out[:n] = _step(out[:n], self.data[self.starts[:n] + k])
        made = np.empty_like(out)
        made[self.order] = out
        for i, rest in self.long:
            made[i] = zlib.crc32(rest, int(made[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        return made


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = MAX_RUN):
    """Words of each text, and for each run length the buckets of the runs and their text offsets."""
    data = shared._LOWER[data]
    starts, ends, word_at = shared.spans(data, offsets, _OTHER)
    words = Words(data, starts, ends)
    register = words.extend(np.full(len(starts), 0xFFFFFFFF, np.uint32))
    n_words, made = np.diff(word_at), []
    last_of = np.cumsum(n_words)
    for run in range(1, longest + 1):
        if run > 1:  # the run that ends a word earlier, a blank, and the word
            register = words.extend(np.concatenate([register[:1], _step(register[:-1], np.uint32(32))]))
        whole = np.arange(len(starts)) - np.repeat(last_of - n_words, n_words) >= run - 1
        made.append(((register[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets), np.concatenate([[0], np.cumsum(np.maximum(n_words - run + 1, 0))])))
    return n_words, made


def _counting(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in shared.slices(batch.column(0)):
                for found, _ in features(data, offsets, buckets)[1]:
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task sends one row a bucket at most, and the driver gets one a bucket."""
    made = df.select(F.col(text_col).cast("string")).mapInArrow(_counting(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found, out = made.toArrow(), np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share in the target over that in the corpus, with one feature more in each bucket."""
    k, most, least = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (most + k) / ((s + 1.0) * (least + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighing(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in shared.slices(batch.column(1)):
                n_words, made = features(data, offsets, len(gain))
                weight, n_features = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for found, at in made:
                    total = np.concatenate([[0], np.cumsum(gain[found])])
                    weight += total[at[1:]] - total[at[:-1]]
                    n_features += np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n_words)), *map(pa.array, (n_words.astype(np.int64), n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable drawn from a digest of the id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score."""
    made = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_weighing(gain), "doc_id long, n_words long, n_features long, weight long")
    return made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


# --- parallel sorting by regular sampling ---------------------------------------------------------

_KEY = ("_down", "_id", "_row")  # ascending: the highest score first, then the smallest id, then any order


@dataclass
class Splitters:
    """The first key of each part but the first one."""

    down: np.ndarray
    id: np.ndarray
    row: np.ndarray

    def part(self, down: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many splitters are at or before each key, by a binary search over all keys at once."""
        lo, hi = np.zeros(len(down), np.int64), np.full(len(down), len(self.down), np.int64)
        for _ in range(len(self.down).bit_length()):
            mid = np.minimum((lo + hi) // 2, max(len(self.down) - 1, 0))
            a, b, c = self.down[mid], self.id[mid], self.row[mid]
            after = (down > a) | (down == a) & ((ids > b) | (ids == b) & (row >= c))
            open_ = lo < hi
            lo, hi = np.where(open_ & after, mid + 1, lo), np.where(open_ & ~after, mid, hi)
        return lo


def thinned(columns: list[np.ndarray], weights: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Regular samples of a sorted run: one where the summed weight passes each multiple of the stride. A
    sample stands for what lies between it and the one before; the last entry stands for the rest."""
    total = np.cumsum(weights)
    if len(total) <= most:
        return columns, weights
    step = -(-int(total[-1]) // most)
    at = np.flatnonzero(np.diff(total // step, prepend=0))
    at = np.union1d(at, [len(total) - 1])
    return [c[at] for c in columns], np.diff(total[at], prepend=0)


def _sampling(most: int, counted: bool):
    """Samples of the run of a task, from a sorted table; ``counted``: its rows stand for ``n`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights = [np.zeros(0, np.int64)] * len(_KEY), np.zeros(0, np.int64)
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, _KEY, strict=True)]
            weights = np.concatenate([weights, batch.column("n").to_numpy() if counted else np.ones(batch.num_rows, np.int64)])
            if len(weights) > 16 * most:  # in a long run, at a 16th of the final stride at most
                held, weights = thinned(held, weights, 8 * most)
        held, weights = thinned(held, weights, most)
        yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(weights)], [*_KEY, "n"])

    return run


def splitters(keys: DataFrame, parts: int) -> Splitters:
    """Splitters of ``parts`` parts of nearly equal size, from regular samples of sorted runs."""
    most, schema = 4 * parts, ", ".join(f"{c} long" for c in (*_KEY, "n"))
    samples = keys.select(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_sampling(most, False), schema)
    samples = samples.repartition(GROUPS).sortWithinPartitions(*_KEY).mapInArrow(_sampling(most, True), schema).toArrow()
    down, ids, row, n = (samples[c].to_numpy() for c in (*_KEY, "n"))
    order = np.lexsort((row, ids, down))
    total = np.cumsum(n[order])
    wanted = (np.arange(1, parts) * (int(total[-1]) if len(total) else 0)) // parts
    at = np.unique(order[np.searchsorted(total, wanted, "right")] if len(total) else np.zeros(0, np.int64))
    at = at[np.lexsort((row[at], ids[at], down[at]))]
    return Splitters(down[at], ids[at], row[at])


def _dealing(found: Splitters, at: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = found.part(*(batch.column(k).to_numpy() for k in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "_part"])

    return run


def _ranking(before: np.ndarray, drawn: int, part_at: int):
    """Ranks in a sorted table of whole parts: the rows of earlier parts and the place in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            part = batch.column(part_at).to_numpy()
            rank = np.empty(len(part), np.int64)
            for p in np.unique(part).tolist():  # one or two a batch
                own = part == p
                n, done = int(np.count_nonzero(own)), seen.get(p, 0)
                rank[own] = before[p] + done + np.arange(1, n + 1)
                seen[p] = done + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, mask=rank > drawn)], [*batch.schema.names, "rank"])

    return run


def ranked(scored: DataFrame, eligible: Column, drawn, id_col: str = "doc_id", score_col: str = "score", part_rows: int = PART_ROWS) -> DataFrame:
    """``scored``, a table with a column ``_row`` that tells its rows apart, with the rank of the eligible rows up to ``drawn(number of
    eligible rows)``, highest score first, ties to the smaller id; the rank of other rows is null. Reads ``scored`` several times, so it should be a written table."""
    keyed = scored.withColumns({"_ok": F.coalesce(eligible, F.lit(False)), "_down": -F.col(score_col), "_id": F.coalesce(F.col(id_col), F.lit(LAST))})
    keys, spark = keyed.where("_ok").select(*_KEY), scored.sparkSession
    n = keys.count()
    top = drawn(n)
    schema = f"{_schema(keyed)}, _part int"
    if top <= 0:
        return scored.select(*(c for c in scored.columns if c != "_row"), F.lit(None).cast("long").alias("rank"))
    found = splitters(keys, min(MAX_PARTS, -(-n // part_rows)))
    dealt = keyed.where("_ok").mapInArrow(_dealing(found, [keyed.columns.index(c) for c in _KEY]), schema)
    sizes = np.zeros(len(found.down) + 1, np.int64)
    for r in dealt.groupBy("_part").count().collect():  # one row a part
        sizes[r["_part"]] = r["count"]
    before = np.cumsum(sizes) - sizes
    live = int(np.count_nonzero(before < top))
    names = [c for c in scored.columns if c != "_row"]
    first = dealt.where(F.col("_part") < live).repartitionById(live, "_part").sortWithinPartitions("_part", *_KEY)
    first = first.mapInArrow(_ranking(before, top, len(keyed.columns)), f"{schema}, rank long").select(*names, "rank")
    rest = dealt.where(F.col("_part") >= live).unionByName(keyed.where("NOT _ok").withColumn("_part", F.lit(live)))
    return first.unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank. ``percent`` of the documents with
    ``min_words`` words at least are drawn; the others have no rank."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    scored = shared.stage(weighed(docs, gain, id_col, text_col, seed).withColumn("_row", F.monotonically_increasing_id()), "scored")
    made = ranked(scored, F.col("n_words") >= min_words, lambda n: percent * n // 100, part_rows=part_rows)
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def texts(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn rows of ``docs``, all columns, and ``drawn_rank``; ids are unique."""
    drawn = resampled.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"), F.col("rank").alias("drawn_rank"))
    return docs.join(drawn, F.col(id_col).cast("long") == F.col("_drawn")).drop("_drawn")
