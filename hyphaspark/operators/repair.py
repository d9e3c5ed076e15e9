"""Repair of shapes that cross, overlap or nest in themselves, as by a buffer of width zero.

A shape's parts are rings, the first of a part its shell and the others its holes. Shells count once around what they enclose,
holes take one away; the repaired shape is what counts above zero. So parts that overlap become their union, and of
a ring that crosses itself the loops that run like the ring as a whole stay (its signed area tells; a ring without one
counts as clockwise).

All steps are joins of edges. Edges of a shape meet in bins about as many as it has edges; where two cross, touch or lie on each
other, both are cut (``cuts``). Only shapes with a cut, or whose parts or holes may nest wrongly, go on; the
others pass as they are. The cut edges are counted by their two ends, opposite ones cancel, and a ray from the middle
of each finds how often the shape winds around either side (``borders``). Edges between inside and outside are kept, with the
inside on their left, and a small function links those of one shape into rings.

Rings need four points and two distinct ones beside the first, else they are dropped; a part without a shell
drops out, and so does a shape of which nothing is left (a line there and back, for example). Points must have two
finite coordinates. Corners and
cuts of repaired shapes are rounded to a fine grain, so that lines that meet in one point still do.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import folders
from . import vectors

GRAIN = 1e-9  # step of the coordinates of repaired shapes, in bins
SLOPE = 0.123456789  # rays rise by this, so that they run along no edge of a map
PARTS = "array<array<array<struct<x: double, y: double>>>>"
_RINGS = "array<array<struct<x: double, y: double>>>"


def signed_area(ring: Column) -> Column:
    """Twice the area, positive if counter-clockwise; relative to the first point, which keeps digits."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    step = lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)
    return F.aggregate(F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), step), F.lit(0.0), lambda s, v: s + v)


def usable(ring: Column) -> Column:
    """Closed, with four points at least and more than two distinct ones, all finite."""
    finite = F.forall(ring, lambda p: F.coalesce(F.abs(p["x"]) < math.inf, F.lit(False)) & F.coalesce(F.abs(p["y"]) < math.inf, F.lit(False)))
    return F.coalesce((F.size(ring) >= 4) & finite & (F.get(ring, F.lit(0)) == F.try_element_at(ring, F.lit(-1))) & (F.size(F.array_distinct(ring)) > 2), F.lit(False))


def _edges(shapes: DataFrame) -> DataFrame:
    """poly_id, k and ax, ay, bx, by of the edges, shells turned counter-clockwise and holes clockwise."""
    rings = shapes.select("poly_id", F.posexplode("parts").alias("part", "rings")).select("poly_id", "part", F.posexplode("rings").alias("ring", "r"))
    turned = F.when((F.col("ring") == 0) == (signed_area(F.col("r")) <= 0), F.reverse("r")).otherwise(F.col("r"))
    rows = rings.select("poly_id", "part", "ring", turned.alias("r"))
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    rows = rows.select("poly_id", "part", "ring", F.posexplode(pairs).alias("i", "e")).select("poly_id", F.struct("part", "ring", "i").alias("k"), "e.*")
    return rows.where("ax <> bx OR ay <> by")


def _with_size(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """With size, the side of a bin, so that a shape has about as many bins as edges, and grain, the step of the
    coordinates of repaired shapes: a power of two, about 1e-10 of the shape."""
    x, y = (F.flatten(F.flatten(F.transform("parts", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: q[c]))))) for c in "xy")
    extent = F.greatest(F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))
    sizes = shapes.select("poly_id", F.greatest(extent / F.ceil(F.sqrt(F.size(x))), F.lit(1e-6) * F.greatest(F.abs(F.array_max(x)), F.abs(F.array_max(y)), F.lit(1e-6))).alias("size"))
    sizes = sizes.withColumn("grain", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size") * GRAIN))))
    return edges.join(sizes, "poly_id")


def cuts(edges: DataFrame) -> DataFrame:
    """poly_id, k, at (points where the edge is to be cut, its ends left out) of all edges that meet another one but
    at a common end; edges that lie on each other have a row without a point. ``edges`` has the side of its bins, size."""
    rows = vectors.by_bins(edges, F.col("size"))
    one = rows.select("poly_id", "bin_x", "bin_y", F.col("k").alias("k1"), F.struct("ax", "ay", "bx", "by").alias("e"))
    two = rows.select("poly_id", "bin_x", "bin_y", F.col("k").alias("k2"), F.struct("ax", "ay", "bx", "by").alias("f"))
    met = one.join(two, ["poly_id", "bin_x", "bin_y"]).where("k1 < k2 AND least(e.ax, e.bx) <= greatest(f.ax, f.bx) AND least(f.ax, f.bx) <= greatest(e.ax, e.bx) AND least(e.ay, e.by) <= greatest(f.ay, f.by) AND least(f.ay, f.by) <= greatest(e.ay, e.by)")
    side = lambda o, px, py: (F.col(f"{o}.bx") - F.col(f"{o}.ax")) * (F.col(py) - F.col(f"{o}.ay")) - (F.col(f"{o}.by") - F.col(f"{o}.ay")) * (F.col(px) - F.col(f"{o}.ax"))
    met = met.withColumns({"d1": side("e", "f.ax", "f.ay"), "d2": side("e", "f.bx", "f.by"), "d3": side("f", "e.ax", "e.ay"), "d4": side("f", "e.bx", "e.by")})
    t = F.col("d3") / (F.col("d3") - F.col("d4"))
    cross = F.when(F.expr("((d1 > 0) <> (d2 > 0)) AND d1 <> 0 AND d2 <> 0 AND ((d3 > 0) <> (d4 > 0)) AND d3 <> 0 AND d4 <> 0"), F.struct((F.col("e.ax") + t * (F.col("e.bx") - F.col("e.ax"))).alias("x"), (F.col("e.ay") + t * (F.col("e.by") - F.col("e.ay"))).alias("y")))

    def touch(d: str, own: str, x: str, y: str) -> Column:
        """The other edge's end, if it lies within this edge."""
        p = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        within = F.col(x).between(F.least(f"{own}.ax", f"{own}.bx"), F.greatest(f"{own}.ax", f"{own}.bx")) & F.col(y).between(F.least(f"{own}.ay", f"{own}.by"), F.greatest(f"{own}.ay", f"{own}.by"))
        end = ((F.col(x) == F.col(f"{own}.ax")) & (F.col(y) == F.col(f"{own}.ay"))) | ((F.col(x) == F.col(f"{own}.bx")) & (F.col(y) == F.col(f"{own}.by")))
        return F.when((F.col(d) == 0) & within & ~end, p)

    on_e, on_f = [touch("d1", "e", "f.ax", "f.ay"), touch("d2", "e", "f.bx", "f.by")], [touch("d3", "f", "e.ax", "e.ay"), touch("d4", "f", "e.bx", "e.by")]
    same = F.expr("(e.ax = f.ax AND e.ay = f.ay AND e.bx = f.bx AND e.by = f.by) OR (e.ax = f.bx AND e.ay = f.by AND e.bx = f.ax AND e.by = f.ay)")
    each = F.array(*[F.struct(F.col(k).alias("k"), F.array_compact(F.array(cross, *on)).alias("at")) for k, on in (("k1", on_e), ("k2", on_f))])
    found = met.select("poly_id", F.explode(each).alias("c"), same.alias("same")).select("poly_id", "c.*", "same").where("same OR size(at) > 0")
    return found.groupBy("poly_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


def may_nest(shapes: DataFrame) -> DataFrame:
    """poly_id of the shapes with parts that lie above or below each other (their boxes share an x), holes that do, or a hole that begins outside its shell."""
    ends = lambda r: F.struct(F.array_min(F.transform(r, lambda p: p["x"])).alias("x0"), F.array_max(F.transform(r, lambda p: p["x"])).alias("x1"))
    rings = shapes.select("poly_id", F.posexplode("parts").alias("part", "p")).select("poly_id", "part", F.posexplode("p").alias("ring", "r"), F.col("p")[0].alias("shell"))
    x, y = F.col("r")[0]["x"], F.col("r")[0]["y"]
    turns = lambda n, i: n + F.when(((F.col("shell")[i]["y"] > y) != (F.col("shell")[i + 1]["y"] > y)) & (x < (F.col("shell")[i + 1]["x"] - F.col("shell")[i]["x"]) * F.try_divide(y - F.col("shell")[i]["y"], F.col("shell")[i + 1]["y"] - F.col("shell")[i]["y"]) + F.col("shell")[i]["x"]), 1).otherwise(0)
    held = F.aggregate(F.sequence(F.lit(0), F.size("shell") - 2), F.lit(0), turns) % 2 == 1
    astray = rings.where(F.col("ring") > 0).where(~held).select("poly_id")
    groups = rings.select("poly_id", F.when(F.col("ring") == 0, -1).otherwise(F.col("part")).alias("g"), ends(F.col("r")).alias("b"))
    # from west to east, each box looks back at the furthest east so far
    w = Window.partitionBy("poly_id", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    beside = groups.withColumn("reach", F.max("b.x1").over(w)).where(F.col("reach") >= F.col("b.x0")).select("poly_id")
    return beside.unionByName(astray).distinct()


def pieces(edges: DataFrame, found: DataFrame) -> DataFrame:
    """poly_id, px, py, qx, qy, n: the cut edges by their rounded ends, the smaller first, and how often they are run from
    there less how often to there."""
    rows = edges.join(found, ["poly_id", "k"], "left")
    along = lambda p: (p["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (p["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))
    inner = F.transform(F.array_sort(F.transform(F.coalesce("at", F.array().cast("array<struct<x: double, y: double>>")), lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    line = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))), inner, F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    on_grain = lambda p: F.struct((F.rint(p["x"] / F.col("grain")) * F.col("grain")).alias("x"), (F.rint(p["y"] / F.col("grain")) * F.col("grain")).alias("y"))
    rows = rows.select("poly_id", F.transform(line, on_grain).alias("l")).select("poly_id", F.explode(F.zip_with(F.slice("l", F.lit(1), F.size("l") - 1), F.slice("l", F.lit(2), F.size("l") - 1), lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), F.when(p < q, 1).otherwise(-1).alias("n")))).alias("s"))
    rows = rows.where("s.p <> s.q").groupBy("poly_id", F.col("s.p").alias("p"), F.col("s.q").alias("q")).agg(F.sum("s.n").alias("n"))
    return rows.where("n <> 0").select("poly_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), "n")


def borders(cut: DataFrame) -> DataFrame:
    """poly_id, ax, ay, bx, by of the pieces between what counts above zero and what does not, the inside on the left. Pieces
    meet the rays from the middles of others in strips of their shape, about as many as the root of its pieces."""
    lift = lambda x, y: F.col(y) + SLOPE * F.col(x)
    rows = cut.withColumns({"pv": lift("px", "py"), "qv": lift("qx", "qy")})
    strips = rows.groupBy("poly_id").agg(F.min(F.least("pv", "qv")).alias("v0"), ((F.max(F.greatest("pv", "qv")) - F.min(F.least("pv", "qv"))) / F.ceil(F.sqrt(F.count("*")))).alias("height"))
    rows = rows.join(strips, "poly_id")
    strip = lambda v: F.floor((v - F.col("v0")) / F.col("height")).cast("long")
    spread = rows.withColumn("strip", F.explode(F.sequence(strip(F.least("pv", "qv")), strip(F.greatest("pv", "qv"))))).select("poly_id", "strip", *[F.col(c).alias(f"o_{c}") for c in ("px", "py", "qx", "qy", "pv", "qv", "n")])
    mine = rows.withColumns({"u": (F.col("px") + F.col("qx")) / 2, "v": (F.col("pv") + F.col("qv")) / 2}).withColumn("strip", strip(F.col("v")))
    ends = ["px", "py", "qx", "qy"]
    met = mine.join(spread, ["poly_id", "strip"])
    other = F.lit(False)
    for c in ends:
        other = other | (F.col(c) != F.col(f"o_{c}"))
    at = (F.col("o_qx") - F.col("o_px")) * F.try_divide(F.col("v") - F.col("o_pv"), F.col("o_qv") - F.col("o_pv")) + F.col("o_px")
    passes = other & ((F.col("o_pv") > F.col("v")) != (F.col("o_qv") > F.col("v"))) & (F.col("u") < at)
    east = F.sum(F.when(passes, F.when(F.col("o_qv") > F.col("o_pv"), F.col("o_n")).otherwise(-F.col("o_n"))).otherwise(0))
    found = met.groupBy("poly_id", *ends).agg(east.alias("east"), F.first("n").alias("n"), F.first(F.col("qv") > F.col("pv")).alias("rises"))
    left = F.when(F.col("rises"), F.col("east") + F.col("n")).otherwise(F.col("east"))
    right = F.when(F.col("rises"), F.col("east")).otherwise(F.col("east") + (-F.col("n")))
    kept = found.withColumns({"in_left": left > 0, "in_right": right > 0}).where("in_left <> in_right")
    pick = lambda a, b: F.when(F.col("in_left"), F.col(a)).otherwise(F.col(b))
    return kept.select("poly_id", pick("px", "qx").alias("ax"), pick("py", "qy").alias("ay"), pick("qx", "px").alias("bx"), pick("qy", "py").alias("by"))


def link(edges: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed rings of directed edges; where several go on, the one that turns most to the left does."""
    onward = defaultdict(list)
    for ax, ay, bx, by in sorted(edges, reverse=True):
        onward[ax, ay].append((bx, by))
    rings = []
    for start in sorted(onward):
        while onward[start]:
            ring = [start, onward[start].pop()]
            while ring[-1] != start and onward.get(ring[-1]):
                (ux, uy), (x, y) = ring[-2:]
                turn = lambda p: math.atan2((x - ux) * (p[1] - y) - (y - uy) * (p[0] - x), (x - ux) * (p[0] - x) + (y - uy) * (p[1] - y))  # noqa: B023, E731
                ring.append(max(onward[x, y], key=turn))
                onward[x, y].remove(ring[-1])
            if ring[-1] == start:
                rings.append(ring)
    return rings


def _linked(key, rows):
    import pandas as pd

    made = link(list(rows[["ax", "ay", "bx", "by"]].itertuples(index=False, name=None)))
    return pd.DataFrame({"poly_id": [key[0]], "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in made]]})


def repaired(shapes: DataFrame) -> DataFrame:
    """poly_id, rings (of which an even number around a point means outside), changed. ``shapes`` has a poly_id of its own in each row,
    and parts. Shapes of which nothing is left drop out. Equal shapes are repaired once. Shapes and cuts are staged, as several joins read them."""
    kept = F.filter(F.transform("parts", lambda p: F.concat(F.filter(F.slice(p, 1, 1), usable), F.when(usable(F.get(p, F.lit(0))), F.filter(F.slice(p, F.lit(2), F.size(p)), usable)).otherwise(F.array().cast(_RINGS)))), lambda p: F.size(p) > 0)
    clean = shapes.select("poly_id", kept.alias("parts"), F.size(F.flatten("parts")).alias("n_rings")).where(F.size("parts") > 0)
    clean = folders.staged(clean.withColumn("same", F.min("poly_id").over(Window.partitionBy("parts"))))
    one = clean.where("poly_id = same")
    edges = _with_size(_edges(one), one)
    found = folders.staged(cuts(edges))  # read twice
    wrong = found.select("poly_id").unionByName(may_nest(one)).distinct()
    some = edges.join(wrong, "poly_id", "left_semi")
    again = borders(pieces(some, found)).groupBy("poly_id").applyInPandas(_linked, f"poly_id long, rings {_RINGS}")
    again = clean.select("poly_id", "same").join(again.withColumnRenamed("poly_id", "same"), "same").drop("same")
    rest = clean.join(wrong.withColumnRenamed("poly_id", "same"), "same", "left_anti")
    dropped = F.size(F.flatten("parts")) < F.col("n_rings")
    return rest.select("poly_id", F.flatten("parts").alias("rings"), dropped.alias("changed")).unionByName(again.where("size(rings) > 0").withColumn("changed", F.lit(True)))
