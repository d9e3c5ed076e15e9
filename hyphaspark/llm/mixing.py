"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a schedule over training time 0..1 (here a linear ramp around its base weight).
The integral of the schedule is the source's demand for tokens up to a time. The documents of a source
follow each other in hash order; a document's cumulative tokens, put into the inverse of the demand,
give the training position of each of its copies, and documents are range-sorted by position.

Targets: the sources in order of name (null last) weigh 1, 2, 3, repeating, and share all tokens of
the table; a target stops at three times its source, and what is left over is shared again by weight
among the others. That has a closed form: with the sources in order of size per weight, the level is
the largest of (tokens left) / (weights left), and a target is the smaller of its cap and weight times level.

Whole documents are taken, in passes over the source: a copy belongs to the mix if its middle lies
before the target, so a source misses its target by half a document at most, and no document is taken
more than three times. Positions need cumulative sums, which come from the sums of hash ranges of a source
and a window inside each range, so a source of any size spreads over many tasks.

Null texts have size 0 and take nothing; a null source is a source of its own. The order hashes id and size, so
rows without an id, or with one id, spread over the ranges too; equal ids and sizes stand for each other. A very
long text is counted where it is read, and no text is moved before its place is known but in ``training_order``. The
windows over sources see one row a source: thousands of sources are fine, a source a document is not. Only the three
named columns are read; further columns have no influence. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MAX_PASSES, RANGE_ROWS = 3, 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), sizes_of(text_col).alias("size"))


def sizes_of(text_col: str) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, weight, target: one row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weighed = sources.withColumn("weight", (F.row_number().over(every) - 1) % 3 + 1).withColumn("cap", MAX_PASSES * F.col("source_size"))
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = tightest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", left / weights)
    return level.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(whole)).alias("target"))


def ramp(weight: Column) -> Column:
    """Slope of the schedule: the weight at time t is its base times 1 + ramp * (2 t - 1). Light
    sources fade, heavy ones grow."""
    return (weight - 2) * F.lit(0.5)


def time_of(part: Column, slope: Column) -> Column:
    """When the integrated schedule reaches this part of the demand: the inverse of
    t -> t (1 - slope) + slope t^2."""
    return 2 * part / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * part))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and the positions
    of its copies in training time (empty if none)."""
    sized = shared.stage(sizes(df, id_col, text_col, source_col), "sized")
    return _placed(sized, sized, "doc_id", "source", "size").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions")


def _placed(rows: DataFrame, sized: DataFrame, id_col: str, source_col: str, size_col: str) -> DataFrame:
    """``rows`` with source_size, weight, target, copies and positions; ``sized`` is their small form."""
    place = lambda c, n: F.md5(F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" "), F.col(n).cast("string")))
    aims = targets(sized)
    count = sized.count()
    digits = 1
    while digits < 7 and count / 16**digits > RANGE_ROWS:
        digits += 1
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("source", F.substring(place("doc_id", "size"), 1, digits).alias("range")).agg(F.sum("size").alias("n"))
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # one key of range and source, so that the join and the window deal the rows out once
    cell = lambda r, s: F.concat(r, F.coalesce(F.concat(F.lit("="), s), F.lit("")))
    ranges = ranges.join(aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(cell(F.col("range"), F.col("source")).alias("_cell"), "range_start", "source_size", "weight", "target")
    placed = rows.withColumn("_place", place(id_col, size_col))
    placed = placed.withColumn("_cell", cell(F.substring("_place", 1, digits), F.col(source_col).cast("string"))).join(ranges, "_cell")
    inside = Window.partitionBy("_cell").orderBy("_place", F.col(id_col).cast("long"), size_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_start", F.col("range_start") + F.coalesce(F.sum(size_col).over(inside), F.lit(0)))
    twice = lambda k: 2 * (k * F.col("source_size") + F.col("_start")) + F.col(size_col)  # noqa: E731  twice the middle of a copy
    passes = F.filter(F.array(*[F.lit(k) for k in range(MAX_PASSES)]), lambda k: (F.col("target") > 0) & (twice(k) <= 2 * F.col("target")))
    positions = F.transform(passes, lambda k: time_of(twice(k) / (2 * F.col("target")), ramp(F.col("weight"))))
    return placed.withColumn("positions", positions).withColumn("copies", F.size("positions").cast("long"))


def ordered(planned: DataFrame) -> DataFrame:
    """The plan in training order, by first position (documents that are not taken last)."""
    return planned.withColumn("position", F.get("positions", F.lit(0))).repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def training_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row of ``df`` for each copy that the mix takes, all columns, range-sorted by position."""
    sized = shared.stage(sizes(df, id_col, text_col, source_col), "sized")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), sizes_of(text_col).alias("size"))
    copies = _placed(rows, sized, "doc_id", "source", "size").select("row", "doc_id", F.explode("positions").alias("position"))
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("row.*")
