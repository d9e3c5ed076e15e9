"""N-gram Jaccard join: rare-first prefix filtering, one verification per pair.

1. One pass over the texts gives each document the fingerprint of its shingle set (documents with
   equal sets form one class) and counts shingles in 2^18 hash buckets. The counts cover every
   document; their table has a fixed size, so it may be collected and broadcast.
2. Shingles are ordered by (bucket count, hash): one total order for all documents, rare ones first.
   A set of n shingles sends its first ``n - ceil(t n) + 1`` shingles to the join, each with its
   position and the set's size and histogram. Shingles that only one class has are dropped. A shingle
   whose bucket counts ``LIST`` occurrences more than the average bucket may have a long list: that is dealt over slots, and
   only the slots' ends are brought together.
3. Rows that share a shingle become candidates if they pass the index-prefix, length, positional and
   suffix (histogram) filters. Each candidate pair is verified once on the whole sets.
4. ``components`` first pairs every row with one class of its shingle's list (the one in whose order
   the shingle comes first: it has the fewest rarer ones, like the origin of a group of near copies)
   and contracts what is linked; the later full join only pairs classes that are not yet connected. A group of
   near copies thus costs a star of pairs, and no link between components is lost.

Above some 30 GB of text the average bucket holds more than ``LIST`` shingles. The order of rare shingles then is mostly that of their
hashes: results stay the same, as any order will do, but prefixes are less rare and candidates more.

Hashes have 64 bits (see ``shared``); a wrong verdict needs a collision among them.

Nulls and empty texts (or texts without a word) have an empty set: ``n_shingles`` 0, linked with
nothing, their own component. A null id takes part; it is never the smallest id of a component that
has another one. Repeated rows are kept and share their class; there are no other ties. A text is never cut: a
very long one is a slice of its own and needs about 60 bytes of memory a word. Only the id and the text column are
read, so further columns, whatever their names, have no influence. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BUCKETS, LIST = 1 << 18, 1 << 14
MAX_BLOOM_BITS = 1 << 27


def _sets(column: pa.Array, n: int):
    """(row, sorted distinct shingle hashes) for each text that has a word."""
    for first, data, offsets in shared.slices(column):
        starts, ends, word_at = shared.spans(data, offsets)
        words = shared.span_hashes(data, starts, ends, lower=True)
        runs = shared.windows(words, n)
        for d in range(len(offsets) - 1):
            lo, hi = int(word_at[d]), int(word_at[d + 1])
            if hi - lo >= n:
                yield first + d, np.unique(runs[lo : hi - n + 1])
            elif hi > lo:
                yield first + d, shared.windows(words[lo:hi], hi - lo) ^ np.uint64(hi - lo)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _key(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = shared.mix(hashes, 1).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(_signed(shared.mix(np.array([total], np.uint64), 2))[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            size, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, hashes in _sets(batch.column(1), n):
                size[row], key[row] = len(hashes), _key(hashes)
                np.add.at(counts, hashes >> np.uint64(46), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(key), batch.column(2)], ["doc_id", "n_shingles", "class_key", "row_key"])
        used = np.flatnonzero(counts)
        for lo in range(0, len(used), 1 << 16):
            part = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), -1)), pa.array(counts[part]), pa.nulls(len(part), pa.string())], ["doc_id", "n_shingles", "class_key", "row_key"])

    return run


def _prefixes(n: int, percent: int, counts, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = counts.value, set()
        load = int(common.mean())  # what a bucket holds of rare shingles, which grows with the corpus
        for batch in batches:
            parts = []
            for _, hashes in _sets(batch.column(0), n):
                key, size = _key(hashes), len(hashes)
                if key in seen:  # a copy of what this task has already sent
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                keep = size - (percent * size + 99) // 100 + 1
                often = common[hashes >> np.uint64(46)]
                order = np.lexsort((hashes, often))[:keep]
                slots = np.maximum(often[order] - load, 0) // most + 1
                slot = np.where(slots > 1, int(shared.mix(np.array([key], np.int64).view(np.uint64), 4)[0] >> np.uint64(1)) % slots, -1)
                hist = np.minimum(np.bincount((hashes >> np.uint64(20)) & np.uint64(3), minlength=4), 0x7FFF)
                sig = int(hist[0] | hist[1] << 16 | hist[2] << 32 | hist[3] << 48)
                parts.append((_signed(hashes[order]), key, size, np.arange(keep), sig, slot))
            if parts:
                lengths = [len(p[0]) for p in parts]
                spread = lambda k, kind: np.repeat(np.array([p[k] for p in parts], kind), lengths)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[0] for p in parts])), pa.array(spread(1, np.int64)), pa.array(spread(2, np.int32)), pa.array(np.concatenate([p[3] for p in parts]).astype(np.int32)), pa.array(spread(4, np.int64)), pa.array(np.concatenate([p[5] for p in parts]).astype(np.int32))],
                    ["token", "key", "n", "pos", "sig", "slot"],
                )

    return run


def _whole_sets(n: int, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bloom.value, set()
        for batch in batches:
            keys, sets = [], []
            for _, hashes in _sets(batch.column(0), n):
                key = _key(hashes)
                if key in seen:  # a copy of what this task has already sent
                    continue
                spot = shared.mix(np.array([key], np.int64).view(np.uint64), 3) & np.uint64(len(bits) * 8 - 1)
                if bits[int(spot[0]) >> 3] >> (int(spot[0]) & 7) & 1:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    sets.append(hashes.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "hashes"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of both sets and of their intersection."""
    for batch in batches:
        counts = np.zeros((3, batch.num_rows), np.int64)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # two sorted runs: a merge
            counts[:, i] = len(x), len(y), np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts)], ["a", "b", "a_n", "b_n", "common"])


def _bounded(rows: DataFrame, percent: int) -> DataFrame:
    """Adds what the filters look at. reach: the largest partner for which this shingle can be the
    first common one (positional filter: what is left of the set must hold the shingles to share);
    indexed: the shingle stands in the shorter prefix that the smaller set of a pair needs."""
    n, pos = F.col("n"), F.col("pos")
    return rows.withColumns({
        "reach": F.floor((100 + percent) * (n - pos) / F.lit(percent) + F.lit(1e-9)).cast("int") - n,
        "indexed": pos < n - F.ceil(F.lit(2 * percent) * n / F.lit(100 + percent) - F.lit(1e-9)) + 1,
    })


def _meets(x: str, y: str, percent: int):
    """Index-prefix, length and positional filters for a smaller x and a larger y. A pair that links
    passes at its first common shingle, so looking at each shingle alone loses none."""
    f = lambda side, c: F.col(f"{side}.{c}")
    return f(x, "indexed") & (f(x, "n") <= f(y, "n")) & (f(x, "n") * 100 >= f(y, "n") * percent) & (f(y, "n") <= f(x, "reach")) & (f(x, "n") <= f(y, "reach"))


def _suffix(x: str, y: str, percent: int):
    """Suffix filter: how far the sets' histograms over fixed parts of the order differ bounds the overlap."""
    part = lambda s, k: F.shiftrightunsigned(F.col(f"{s}.sig"), 16 * k).bitwiseAND(F.lit(0xFFFF))
    apart = sum((F.abs(part(x, k) - part(y, k)) for k in range(1, 4)), F.abs(part(x, 0) - part(y, 0)))
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (both - apart) * (100 + percent) >= 2 * percent * both


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("a_n"), F.col("y.n").alias("b_n")).distinct()


def _smaller(x: str, y: str):
    return (F.col(f"{x}.n") < F.col(f"{y}.n")) | ((F.col(f"{x}.n") == F.col(f"{y}.n")) & (F.col(f"{x}.key") < F.col(f"{y}.key")))


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates between each row and the hub of its shingle's list: the class in whose order the
    shingle comes first has the fewest rarer ones, like the origin of a group of near copies."""
    row = F.struct("key", "n", "pos", "sig", "reach", "indexed")
    rows = _bounded(rows, percent).select("token", row.alias("r"))
    hubs = rows.groupBy("token").agg(F.min(F.struct("r.pos", "r.key", "r")).alias("least")).select("token", F.col("least.r").alias("hub"))
    met = rows.join(hubs, "token").where("r.key <> hub.key")
    first = _smaller("r", "hub")
    met = met.select(F.when(first, F.col("r")).otherwise(F.col("hub")).alias("x"), F.when(first, F.col("hub")).otherwise(F.col("r")).alias("y"))
    return _pairs(met.where(_meets("x", "y", percent) & _suffix("x", "y", percent)))


def _tokens(rows: DataFrame) -> DataFrame:
    """key and its shingles in ``rows``."""
    return shared.stage(rows.groupBy("key").agg(F.collect_set("token").alias("tokens")), "tokens")


def _paired(rows: DataFrame, percent: int, tried: DataFrame | None = None) -> DataFrame:
    """Candidates among all rows of a shingle that differ in ``comp``, less those ``tried`` before, staged.

    Rows of one list with equal size and reach form a cell. Cells are compared first, and rows only
    meet where their cells do, so the many rows of a group that is connected already, or of texts too
    far apart, are not compared one by one."""
    cell = ["token", "n", "reach", "indexed"]
    rows = _bounded(rows, percent)
    cells = shared.stage(rows.groupBy(*cell).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "cells")
    several = cells.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    some = cells.join(several, "token", "left_semi")
    alike = (F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo"))
    met = some.alias("x").join(some.alias("y"), F.col("x.token") == F.col("y.token")).where(_meets("x", "y", percent) & ~alike)
    met = met.select("x.token", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in cell[1:]])
    for side in "xy":
        own = rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in cell[1:]], F.struct("key", "n", "sig", "comp").alias(side))
        met = met.join(own, ["token", *[f"{side}_{c}" for c in cell[1:]]])
    pairs = _pairs(met.where((F.col("x.comp") != F.col("y.comp")) & _smaller("x", "y") & _suffix("x", "y", percent)))
    return shared.stage(pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs", cells)


def _overlapping(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes share enough. Of two sets, one prefix ends first in the order; every common
    shingle up to there is in both prefixes, and beyond it that set only has its ceil(t n) - 1 others.
    ``tokens`` has the prefix shingles that several classes have, the only ones that can be shared."""
    rest = lambda c: F.ceil(F.lit(percent) * F.col(c) / F.lit(100) - F.lit(1e-9)) - 1
    least = F.ceil(F.lit(percent) * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent) - F.lit(1e-9))
    both = pairs.join(tokens.toDF("a", "a_tokens"), "a").join(tokens.toDF("b", "b_tokens"), "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(common >= least - F.greatest(rest("a_n"), rest("b_n"))).select("a", "b", "a_n", "b_n")


def _links(pairs: DataFrame, tokens: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough, staged."""
    spark = pairs.sparkSession
    pairs = shared.stage(_overlapping(pairs, tokens, percent), "overlapping")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    count = involved.count()
    if not count:
        return shared.stage(spark.createDataFrame([], "a long, b long"), "links", pairs)
    size = min(MAX_BLOOM_BITS, 1 << max(16, int(count * 8).bit_length()))
    # The bloom filter only spares copies of sets; its size is bounded and its bits are set in tasks.
    low = F.pandas_udf(lambda keys: _spots(keys, size), "long")
    words = involved.select(low("key").alias("spot")).select(F.expr("spot DIV 32").alias("word"), F.expr("shiftleft(1L, CAST(spot % 32 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 32, np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    bloom = spark.sparkContext.broadcast(bits.view(np.uint8))
    # A set travels once to its class and from there to each of its pairs, where both sides meet.
    sets = texts.mapInArrow(_whole_sets(n, bloom), "key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    sent = ends.join(sets, "key")
    side = lambda c: F.max(F.when(F.col("key") == F.col(c), F.col("hashes")))
    both = sent.groupBy("a", "b").agg(side("a").alias("a_hashes"), side("b").alias("b_hashes"))
    found = both.mapInArrow(_verify, "a long, b long, a_n long, b_n long, common long")
    return shared.stage(found.where(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * percent).select("a", "b"), "links", pairs)


def _spots(keys, size: int):
    import pandas as pd

    return pd.Series((shared.mix(keys.to_numpy(np.int64).view(np.uint64), 3) & np.uint64(size - 1)).astype(np.int64))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected edge table (a, b), root the smallest node: alternating large
    and small stars, staged each round, until nothing changes."""
    now = shared.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = shared.stage(small, "edges", now)
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == state:
            return shared.staged_as(now.select(F.col("u").alias("node"), F.col("v").alias("root")), now)
        state = after


def _prepared(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, row_key: Column | None = None):
    """Membership (doc_id, n_shingles, class_key, row_key), the texts, and the prefix rows, both staged."""
    spark = df.sparkSession
    key = F.lit(None).cast("string") if row_key is None else row_key
    read = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("row_key"))
    made = shared.stage(read.mapInArrow(_fingerprints(n), "doc_id long, n_shingles long, class_key long, row_key string"), "classes")
    members = shared.staged_as(made.where("n_shingles >= 0"), made)
    counts = np.zeros(BUCKETS, np.int64)
    table = made.where("n_shingles < 0").groupBy("doc_id").agg(F.sum("class_key").alias("n")).toArrow()
    counts[table["doc_id"].to_numpy()] = table["n"].to_numpy()
    texts = read.select("text")
    sent = texts.mapInArrow(_prefixes(n, percent, spark.sparkContext.broadcast(counts), LIST), "token long, key long, n int, pos int, sig long, slot int")
    lists = Window.partitionBy("token", "slot")
    sent = sent.withColumns({"lo": F.min("key").over(lists), "hi": F.max("key").over(lists)}).where("slot >= 0 OR lo <> hi").distinct()
    sent = shared.stage(sent, "prefixes")
    dealt = sent.where("slot >= 0")
    if dealt.take(1):
        several = dealt.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
        sent = shared.stage(sent.where("slot < 0").unionByName(dealt.join(several, "token", "left_semi")), "prefixes", sent)
    return members, texts, shared.staged_as(sent.drop("slot", "lo", "hi"), sent)


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets: (a, b) of class keys, and the membership
    (doc_id, n_shingles, class_key). Its size is that of the answer; ``components`` needs far less."""
    members, texts, rows = _prepared(df, id_col, text_col, n, percent)
    pairs = _paired(rows.withColumn("comp", F.col("key")), percent)
    return _links(pairs, _tokens(rows), texts, n, percent), members.drop("row_key")


def _rooted(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, row_key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The membership, and (class_key, root) of the classes that have a shingle, both staged: root is one class
    of the component."""
    members, texts, rows = _prepared(df, id_col, text_col, n, percent, row_key)
    tried = shared.stage(_stars(rows, percent), "pairs")
    tokens = _tokens(rows)
    edges = _links(tried, tokens, texts, n, percent)
    roots = connected(edges)
    rest = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    rest = shared.stage(rest, "rest", rows)
    pairs = _paired(rest, percent, tried)
    shared.discard(rest, tried)
    more = _links(pairs, tokens, texts, n, percent)
    shared.discard(pairs, tokens)
    if more.take(1):
        shared.discard(roots)
        roots = connected(edges.union(more))
    classes = members.where("n_shingles > 0").select("class_key").distinct()
    classes = classes.join(roots.withColumnRenamed("node", "class_key"), "class_key", "left").select("class_key", F.coalesce("root", "class_key").alias("root"))
    return members, shared.stage(classes, "roots", roots, edges, more)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach),
    class_key (equal for equal sets). Sets link when 100 * intersection >= percent * union."""
    members, classes = _rooted(df, id_col, text_col, n, percent)
    least = members.where("n_shingles > 0").groupBy("class_key").agg(F.min("doc_id").alias("least")).join(classes, "class_key").groupBy("root").agg(F.min("least").alias("component_id"))
    least = shared.stage(least, "least")  # so that a root with many classes can be split in the join
    named = shared.stage(classes.join(least, "root").select("class_key", "component_id"), "components", classes, least)
    out = members.join(named, "class_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_key")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``df`` less near duplicates: of each component one row stays, the one with the smallest id
    (null last; of several texts under one id, that with the smallest digest). Rows are told apart by id and
    text, so another text under the id of a duplicate stays. Rows with equal id and text count once, whatever their
    other columns; texts without a word are linked with nothing."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    members, classes = _rooted(df, id_col, text_col, n, percent, key)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    firsts = members.where("n_shingles > 0").groupBy("class_key").agg(F.min(place).alias("first")).join(classes, "class_key")
    least = shared.stage(firsts.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.row_key").alias("kept")), "least")
    firsts = shared.stage(classes.join(least, "root").select("class_key", "kept"), "kept", classes, least)
    known = members.join(firsts, "class_key", "left").groupBy("row_key").agg(F.max(F.col("row_key") != F.coalesce("kept", "row_key")).alias("gone"), F.count("*").alias("times"))
    known = shared.stage(known.where("gone OR times > 1"), "known", members, firsts)
    rows = df.select(F.struct("*").alias("row"), key.alias("row_key"))
    # what goes grows with the table, so it is joined alike at every size, never sent to all tasks
    single = rows.join(known.select("row_key").hint("merge"), "row_key", "left_anti").select("row.*")
    repeated = known.where("NOT gone").select("row_key")
    if not repeated.take(1):
        return single
    return single.unionByName(rows.join(repeated, "row_key", "left_semi").groupBy("row_key").agg(F.first("row").alias("row")).select("row.*"))
