"""Continuous Boyce Index: do better-scored cells hold more presences than chance puts there?

One job for all species. Windows overlap (100 of them, a tenth of the range wide); each point finds
the range of windows that hold it from their even spacing, so no point is compared with all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS, WIDTH = 100, 0.1


def _counted(points: DataFrame) -> DataFrame:
    """A row for each species, kind and score, with the number n of its points. What reads the points several times finds them in one exchange."""
    n = F.sum("n") if "n" in points.columns else F.count(F.lit(1))
    return points.groupBy("species", "kind", "score").agg(n.alias("n"))


def _number(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))


def boyce_curve(points: DataFrame, n_windows: int = WINDOWS, width: float = WIDTH) -> DataFrame:
    """species, win (from 0), center, pe: presence over expectation where background lies in the window.
    ``points`` has species, kind (pres or bg), score and, if a row stands for several points, their number n."""
    points = _counted(points)
    extent = points.groupBy("species").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), *[_number(k).alias(f"n_{k}") for k in ("pres", "bg")])
    extent = extent.where((F.col("hi") > F.col("lo")) & (F.col("n_pres") > 0) & (F.col("n_bg") > 0)).withColumn("w", (F.col("hi") - F.col("lo")) * width)
    extent = extent.withColumn("step", (F.col("hi") - F.col("lo") - F.col("w")) / (n_windows - 1))
    rows = points.join(extent, "species")
    offset = (F.col("score") - F.col("lo")) / F.col("step")
    first = F.greatest(F.lit(0), F.floor(offset - F.col("w") / F.col("step")).cast("int"))
    last = F.least(F.lit(n_windows - 1), F.ceil(offset).cast("int"))
    center = lambda win: F.col("lo") + F.col("w") / 2 + win * F.col("step")
    first = F.when(F.col("score") > center(first) + F.col("w") / 2, first + 1).otherwise(first)  # the division may round either way
    last = F.when(F.col("score") < center(last) - F.col("w") / 2, last - 1).otherwise(last)
    # a point enters at its first window and leaves after its last: two rows a point, then running sums of 100 windows
    turns = rows.select("species", "kind", F.explode(F.array(F.struct(first.alias("win"), F.col("n")), F.struct((last + 1).alias("win"), (-F.col("n")).alias("n")))).alias("t"))
    turns = turns.groupBy("species", F.col("t.win").alias("win")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("t.n")).otherwise(0)).alias(k) for k in ("pres", "bg")])
    windows = extent.select("species", "lo", "w", "step", "n_pres", "n_bg", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("win"))
    running = Window.partitionBy("species").orderBy("win")
    counts = windows.join(turns, ["species", "win"], "left").withColumns({k: F.sum(F.coalesce(k, F.lit(0))).over(running) for k in ("pres", "bg")})
    share = lambda k: F.col(k) / F.col(f"n_{k}")
    return counts.where("bg > 0").select("species", "win", center(F.col("win")).alias("center"), (share("pres") / share("bg")).alias("pe"))


def boyce(points: DataFrame, n_windows: int = WINDOWS, width: float = WIDTH) -> DataFrame:
    """species, boyce, n_presence, n_background: the rank correlation (ordinal ranks, ties by window)
    between windows and their ratio; NaN where it is not defined."""
    points = _counted(points)
    curve = boyce_curve(points, n_windows, width)
    by = lambda *c: F.row_number().over(Window.partitionBy("species").orderBy(*c))
    ranked = curve.withColumns({"r1": by("center"), "r2": by("pe", "center")})
    index = ranked.groupBy("species").agg(F.when(F.count("*") >= 2, F.corr("r1", "r2")).alias("boyce"))
    sizes = points.groupBy("species").agg(_number("pres").alias("n_presence"), _number("bg").alias("n_background"))
    return sizes.join(index, "species", "left").select("species", F.coalesce("boyce", F.lit(float("nan"))).alias("boyce"), "n_presence", "n_background")


def validate(presences: DataFrame, background: DataFrame, maps: DataFrame, corner: tuple[float, float], step: float) -> DataFrame:
    """The index of every mapped species: scores of its presences (species, x, y) against those of background
    points (x, y) that all species share. Maps have species, i (from the north), j and score. Points off the map have no score
    and do not count; a species without presences has NaN. Points of a cell have its score, so they are counted before they meet the maps."""
    cell = {"i": F.floor((corner[1] - F.col("y")) / step).cast("int"), "j": F.floor((F.col("x") - corner[0]) / step).cast("int")}
    pres = presences.withColumns(cell).groupBy("species", "i", "j").agg(F.count("*").alias("n")).join(maps, ["species", "i", "j"]).select("species", "score", "n", F.lit("pres").alias("kind"))
    bg = background.withColumns(cell).groupBy("i", "j").agg(F.count("*").alias("n")).join(maps, ["i", "j"]).select("species", "score", "n", F.lit("bg").alias("kind"))
    return boyce(pres.unionByName(bg))


def compare(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """species, boyce of both models and their difference."""
    return baseline.select("species", F.col("boyce").alias("baseline")).join(variant.select("species", F.col("boyce").alias("variant")), "species").withColumn("delta", F.col("variant") - F.col("baseline"))
