"""LM scoring by cross-entropy difference.

Two word bigram models of one design: the background model counts every document of the table, the
target model every document that is labelled good. Each distinct word (lower-cased A-Z) and each
distinct pair of neighbouring words of the corpus has counts of its own, compared by 64-bit hashes;
nothing is capped, so the tables of counts grow with the corpus and are never collected or broadcast.

p(w | v) = (c(v, w) + mu p(w)) / (c(v) + mu), p(w) = (c(w) + 1) / (N + V), where N is a model's words
and V the distinct words of the corpus and two more (unknown words, starts of texts).

Documents are dealt by id to blocks of about ``BLOCK`` bytes. A block sends its distinct words and pairs
with their counts in it, dealt by hash to as many parts as there are blocks; a part sums each key and
answers every block with the totals, in the order the block asked in. So a word or pair, however common,
is one entry a block, and only scalars (N, V) reach the driver. Blocks of the same rows that train and
score are sent once.

A document's score is its loss per token under the target model less that under the background
model, in nats: low for texts like the target. A null text, or one without a word, has no tokens,
losses of 0 and score 0. A very long text stays whole in its block. There are no ties: a score is that of the text
alone, given the corpus. Without any labelled document the target model is uniform. Rows are mapped
one to one (repeated rows and null ids stay); only the named columns are read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MU, BLOCK = 50.0, 8 << 20
_START = np.uint64(0x5851F42D4C957F2D)  # stands before the first word of a text


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of a task."""
    held, n = [], 0

    def summed():
        words = np.concatenate([w for w, _ in held])
        counts = np.concatenate([c for _, c in held])
        words, inverse = np.unique(words, return_inverse=True)
        return words, np.bincount(inverse, weights=counts).astype(np.int64)

    def rows(words, counts):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    for batch in batches:
        for _, data, offsets in shared.slices(batch.column(0)):
            starts, ends, _ = shared.spans(data, offsets)
            words, counts = np.unique(shared.span_hashes(data, starts, ends, lower=True), return_counts=True)
            held.append((words, counts))
            n += len(words)
            if n > 1 << 21:
                held = [summed()]
                n = len(held[0][0])
                if n > 1 << 20:
                    yield rows(*held[0])
                    held, n = [], 0
    if n:
        yield rows(*summed())


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text."""
    for batch in batches:
        for first, data, offsets in shared.slices(batch.column(1)):
            n = np.diff(shared.spans(data, offsets)[2])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n.astype(np.int64))], ["id", "n"])


def _pack(x: np.ndarray) -> bytes:
    """Rows of integers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(len(x), -1).T), codec="zstd", asbytes=True)


def _unpack(packed, n: int, columns: int, dtype) -> np.ndarray:
    width = columns * np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n, columns)


class _Block:
    """The words of some texts: ``keys`` are the distinct words, the start and the distinct pairs, sorted;
    ``word``, ``before`` and ``pair`` are the places of each token's in them."""

    def __init__(self, texts: pa.Array):
        words, counts = [], []
        for _, data, offsets in shared.slices(texts):
            starts, ends, at = shared.spans(data, offsets)
            words.append(shared.span_hashes(data, starts, ends, lower=True))
            counts.append(np.diff(at))
        self.n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        hashes = np.concatenate([[_START], *words]).astype(np.uint64)
        edges = np.concatenate([[0], np.cumsum(self.n)])
        distinct, word = np.unique(hashes, return_inverse=True)
        before = word[:-1].copy()
        before[edges[:-1][self.n > 0]] = word[0]
        with np.errstate(over="ignore"):
            pairs, pair = np.unique(shared.mix(shared.mix(distinct, 5)[before] + hashes[1:], 6), return_inverse=True)
        both = np.concatenate([distinct, pairs])
        order = np.argsort(both, kind="stable")
        place = np.empty(len(both), np.int64)
        place[order] = np.arange(len(both))
        self.keys, self.edges = both[order], edges
        self.word, self.before, self.pair = place[word[1:]], place[before], place[len(distinct) + pair]

    def counts(self, target: np.ndarray) -> np.ndarray:
        """For each key its count as a word or pair, then as a word before, background and target each."""
        chosen, size = np.repeat(target, self.n), len(self.keys)
        count = lambda at, some: np.bincount(at[some], minlength=size)
        every = slice(None)
        return np.stack([count(self.word, some) + count(self.pair, some) for some in (every, chosen)] + [count(self.before, some) for some in (every, chosen)], 1)


def _combined(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], table[name].type)


_ASKED = "part long, block long, n long, keys binary, counts binary"
_TOLD = "block long, part long, n long, totals binary"
_SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _asker(parts: int, counting: bool, asking: bool):
    """What a block sends each part: its keys (as steps), its counts if it trains, its number if it asks."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)

    def run(docs: pa.Table, good: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows:
            block = _Block(_combined(docs, "text"))
            ids = _combined(docs, "id")
            target = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), good["id"].to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            counts = block.counts(target) if counting else None
            cuts = [0, *np.searchsorted(block.keys, bounds), len(block.keys)]
            number = docs["block"][0].as_py() if asking else None
            for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if lo < hi:
                    steps = np.diff(block.keys[lo:hi], prepend=np.uint64(0))
                    rows.append((part, number, int(hi - lo), _pack(steps), _pack(counts[lo:hi]) if counting else None))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({"part": pa.array(cols[0], pa.int64()), "block": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64()), "keys": pa.array(cols[3], pa.binary()), "counts": pa.array(cols[4], pa.binary())})

    return run


def _summer(asked: pa.Table) -> pa.Table:
    """The totals of a part's keys, for each block that asks."""
    n = asked["n"].to_pylist()
    with np.errstate(over="ignore"):
        keys = np.concatenate([np.cumsum(_unpack(k.as_buffer(), m, 1, np.uint64)[:, 0], dtype=np.uint64) for k, m in zip(asked["keys"], n, strict=True)])
    distinct, at = np.unique(keys, return_inverse=True)
    totals = np.zeros((len(distinct), 4), np.int64)
    edges = np.concatenate([[0], np.cumsum(n)])
    for c, m, lo in zip(asked["counts"], n, edges, strict=False):
        if c.is_valid:
            totals[at[lo : lo + m]] += _unpack(c.as_buffer(), m, 4, np.int64)  # a block's keys are distinct
    rows = [(b, m, _pack(totals[at[lo : lo + m]])) for b, m, lo in zip(asked["block"].to_pylist(), n, edges, strict=False) if b is not None]
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    part = [asked["part"][0].as_py()] * len(rows)
    return pa.table({"block": pa.array(cols[0], pa.int64()), "part": pa.array(part, pa.int64()), "n": pa.array(cols[1], pa.int64()), "totals": pa.array(cols[2], pa.binary())})


def _scorer(background_n: int, target_n: int, words: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        losses = [np.zeros(docs.num_rows)] * 2
        n = np.zeros(docs.num_rows, np.int64)
        if docs.num_rows:
            block = _Block(_combined(docs, "text"))
            told = told.sort_by("part")
            totals = np.concatenate([_unpack(t.as_buffer(), m, 4, np.int64) for t, m in zip(told["totals"], told["n"].to_pylist(), strict=True)])
            if len(totals) != len(block.keys):
                raise ValueError(f"{len(totals)} totals for {len(block.keys)} keys of a block")
            n, losses = block.n, []
            for model, tokens in enumerate((background_n, target_n)):
                counts, contexts = totals[:, model], totals[:, 2 + model]
                p = (counts[block.word] + 1) / (tokens + words)
                loss = np.log(contexts[block.before] + MU) - np.log(counts[block.pair] + MU * p)
                total = np.concatenate([[0], np.cumsum(loss)])
                losses.append((total[block.edges[1:]] - total[block.edges[:-1]]) / np.maximum(n, 1))
        return pa.table({"doc_id": docs["id"], "n_tokens": pa.array(n.astype(np.int64)), "target_loss": pa.array(losses[1]), "background_loss": pa.array(losses[0]), "score": pa.array(losses[1] - losses[0])})

    return run


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def train(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Both models: their rows, and the sizes that all scores need. ``good`` has the ids of the documents
    labelled good in its first column."""
    docs = _columns(docs, id_col, text_col)
    ids = good.select(F.col(good.columns[0]).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    counted = docs.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    size = counted.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    lengths = docs.mapInArrow(_lengths, "id long, n long").join(ids, "id", "left_semi")
    target = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return {"docs": docs, "good": ids, "words": size["words"] + 2, "background_n": size["n"], "target_n": target}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference, in nats per token)."""
    docs = _columns(docs, id_col, text_col)
    same = docs.sameSemantics(model["docs"])
    held = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    of_docs = held(docs)
    of_model = of_docs if same else held(model["docs"])
    parts = max(of_docs, of_model) // BLOCK + 1

    def dealt(df: DataFrame, size: int) -> DataFrame:
        by = F.xxhash64(F.col("id")) if "text" not in df.columns else F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
        return df.withColumn("block", F.pmod(by, F.lit(size // BLOCK + 1)))

    def asked(df: DataFrame, size: int, counting: bool, asking: bool) -> DataFrame:
        return dealt(df, size).groupBy("block").cogroup(dealt(model["good"], size).groupBy("block")).applyInArrow(_asker(parts, counting, asking), _ASKED)

    if same:
        sent = asked(docs, of_docs, True, True)
    else:
        sent = asked(model["docs"], of_model, True, False).unionByName(asked(docs, of_docs, False, True))
    told = sent.groupBy("part").applyInArrow(_summer, _TOLD)
    return dealt(docs, of_docs).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scorer(model["background_n"], model["target_n"], model["words"]), _SCORED)
