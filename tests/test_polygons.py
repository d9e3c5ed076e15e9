"""Repair of shapes against the winding rule, and the parity index on large polygons, point by point."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyphaspark.operators import repair, vectors

RINGS = "poly_id long, attr string, region string, rings array<array<struct<x: double, y: double>>>"


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def winding(x, y, ring):
    total = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            total += 1 if by > ay else -1
    return total


def counted(x, y, parts):
    """How often the shape counts at a point: shells once, holes less."""
    total = 0
    for part in parts:
        for k, ring in enumerate(part):
            sign = 1 if area(ring) > 0 else -1
            total += winding(x, y, ring) * (sign if k == 0 else -sign if area(ring) else 1)
    return total


def even_odd(x, y, rings):
    return sum(winding(x, y, r) % 2 for r in rings) % 2 == 1


def closed(points):
    return [*points, points[0]]


def shapes():
    rng = random.Random(11)
    at = lambda: (float(rng.randint(0, 8)), float(rng.randint(0, 8)))
    made = []
    for _ in range(140):  # whole numbers make ends meet edges, and edges lie on each other
        parts = []
        for _ in range(rng.choice([1, 1, 2, 3])):
            rings = [closed([at() for _ in range(rng.randint(3, 8))]) for _ in range(rng.choice([1, 1, 2, 3]))]
            parts.append(rings)
        made.append(parts)
    for _ in range(40):  # no two lines alike
        made.append([[closed([(rng.uniform(0, 8), rng.uniform(0, 8)) for _ in range(rng.randint(3, 12))])] for _ in range(rng.choice([1, 2]))])
    return made


def usable(ring):
    return len(ring) >= 4 and len(set(ring)) > 2


def test_like_winding(spark):
    data = shapes()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(data)], f"poly_id long, parts {repair.PARTS}")
    got = {r.poly_id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in repair.repaired(df).collect()}
    rng = random.Random(3)
    inside = 0
    for i, parts in enumerate(data):
        parts = [[r for r in p if usable(r)] for p in parts if usable(p[0])]
        rings = got.get(i, [])
        assert all(r[0] == r[-1] and len(r) >= 4 for r in rings)
        for _ in range(60):
            x, y = rng.uniform(-0.5, 8.5), rng.uniform(-0.5, 8.5)
            want = counted(x, y, parts) > 0
            assert even_odd(x, y, rings) == want, (i, parts, rings, (x, y))
            inside += want
    assert inside > 1000


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_known_shapes(spark):
    bow = lambda a, b: closed([(-a, -a), (b, b), (b, -b), (-a, a)])
    known = {
        1: ([[box(0.0, 0.0, 4.0, 4.0)]], 1, 32.0, False),
        2: ([[bow(2.0, 1.0)]], 1, 8.0, True),  # the larger loop stays
        3: ([[bow(1.0, 1.0)]], 1, 2.0, True),  # of equal loops the clockwise one
        4: ([[box(0.0, 0.0, 4.0, 4.0)], [box(2.0, 2.0, 6.0, 6.0)]], 1, 56.0, True),  # a union
        5: ([[box(0.0, 0.0, 8.0, 8.0)], [box(2.0, 2.0, 3.0, 3.0)]], 1, 128.0, True),  # a part within a part
        6: ([[box(0.0, 0.0, 8.0, 8.0), box(2.0, 2.0, 3.0, 3.0)]], 2, 126.0, False),  # a hole
        7: ([[box(0.0, 0.0, 8.0, 8.0), box(9.0, 2.0, 9.5, 3.0)]], 1, 128.0, True),  # a hole outside
        8: ([[closed([(0.0, 0.0), (4.0, 4.0), (8.0, 8.0)])]], 0, 0.0, True),  # there and back
        9: ([[box(0.0, 0.0, 4.0, 4.0)], [box(4.0, 0.0, 8.0, 4.0)]], 1, 64.0, True),  # a common side goes
        10: ([[box(0.0, 0.0, 4.0, 4.0)], [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], [box(20.0, 0.0, 24.0, 4.0)]], 2, 64.0, True),  # a part that is no ring
        11: ([[box(0.0, 0.0, 4.0, 4.0)], [box(0.0, 0.0, 4.0, 4.0)]], 1, 32.0, True),  # twice the same
        12: ([[list(reversed(box(0.0, 0.0, 4.0, 4.0)))]], 1, 32.0, False),
    }
    bad = [(20, []), (21, [[]]), (22, [[box(0.0, 0.0, float("nan"), 1.0)]]), (23, [[[(0.0, 0.0), (1.0, 0.0), (1.0, None), (0.0, 0.0)]]]), (24, None)]
    df = spark.createDataFrame([(i, p[0]) for i, p in known.items()] + bad, f"poly_id long, parts {repair.PARTS}")
    got = {r.poly_id: ([[(p.x, p.y) for p in ring] for ring in r.rings], r.changed) for r in repair.repaired(df).collect()}
    for i, (_, n, twice, changed) in known.items():
        rings, was = got.pop(i, ([], True))
        net = sum(abs(area(r)) * (-1 if k and n == 2 and i == 6 else 1) for k, r in enumerate(sorted(rings, key=lambda r: -abs(area(r)))))
        assert (len(rings), net, was) == (n, twice, changed), i
    assert got == {} and repair.repaired(df.limit(0)).collect() == []


def star(n, spikes, radius):
    """A ring of n corners with spikes all around: edges in all directions, over many bins."""
    t = np.arange(n) * 2 * np.pi / n
    r = radius * (0.75 + 0.25 * np.cos(spikes * t) * np.where(np.arange(n) % 2, 1.0, 0.9))
    ring = list(zip((r * np.cos(t)).tolist(), (r * np.sin(t)).tolist()))
    return [*ring, ring[0]]


def inside_ring(x, y, ring):
    ring = np.array(ring)
    ax, ay, bx, by = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    out = []
    for px, py in zip(x, y):
        up = (ay > py) != (by > py)
        out.append(np.count_nonzero(px < (bx[up] - ax[up]) * (py - ay[up]) / (by[up] - ay[up]) + ax[up]) % 2 == 1)
    return np.array(out)


def test_large_polygon(spark):
    """100,000 corners over some 5,000 bins: edge rows follow the edges, and every point is placed right."""
    big, size = star(100_000, 37, 100_000.0), 2200.0
    polys = spark.createDataFrame([(1, "a", "tn", [big, box(-500.0, -500.0, 30000.0, 700.0)])], RINGS)
    bins = vectors.parity_bins(polys, size).select(F.size("edges").alias("n"), "odd").cache()
    totals = bins.agg(F.sum("n").alias("edges"), F.count("*").alias("bins"), F.count_if(F.col("n") == 0).alias("whole"), F.count_if((F.col("n") == 0) & ~F.col("odd")).alias("void")).first()
    assert totals.edges < 2.5 * 100_000 and totals.bins > 3000 and totals.whole > 1000 and totals.void == 0
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-105_000, 105_000, 3000), rng.uniform(-105_000, 105_000, 3000)
    x[:300], y[:300] = np.round(x[:300], -3), np.round(y[:300], -3)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x double, y double")
    got = {r.k for r in vectors.containing(points, polys, "k", size).collect()}
    hole = (x > -500) & (x < 30000) & (y > -500) & (y < 700)
    want = set(np.flatnonzero(inside_ring(x, y, big) & ~hole).tolist())
    assert got == want and len(want) > 500


@pytest.mark.parametrize("size", [700.0, 2200.0, 50_000.0])
def test_many_shapes_and_bins(spark, size):
    """Any bin size gives the same answer, on slanting edges and on edges along the axes, for points on borders too."""
    rng = np.random.default_rng(5)
    rings = {k: star(int(rng.integers(4, 60)), int(rng.integers(2, 7)), float(rng.uniform(500, 9000))) for k in range(20)}
    rings = {k: [(px + k * 500.0 - 5000.0, py) for px, py in r] for k, r in rings.items()}
    rings |= {20 + k: box(-3000.0 + 500 * k, -2000.0, 4000.0, 100.0 * k + 50) for k in range(5)}
    polys = spark.createDataFrame([(k, "a", "tn", [r]) for k, r in rings.items()], RINGS)
    x, y = rng.uniform(-12_000, 12_000, 800), rng.uniform(-9000, 9000, 800)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(900, -3000.0, 0.0), (901, 4000.0, 50.0)], "k long, x double, y double")
    inside = {k: inside_ring(x, y, r) for k, r in rings.items()}
    want = {i: min((k for k in rings if inside[k][i]), default=None) for i in range(800)}
    got = {r.k: r.poly_id for r in vectors.containing(points, polys.where("poly_id < 25"), "k", size).collect()}
    assert {k: v for k, v in got.items() if k < 800} == {k: v for k, v in want.items() if v is not None}
    near = {r.k: (r.poly_id, r.dist) for r in vectors.nearest(points.where("k < 800"), polys, "k", 1500.0, size).collect()}
    for i in range(0, 800, 7):
        best = min((min(segment(x[i], y[i], a, b) for a, b in zip(r, r[1:])), k) for k, r in rings.items())
        assert (i in near) == (best[0] <= 1500) and (i not in near or abs(near[i][1] - best[0]) < 1e-6)


def segment(x, y, a, b):
    d = np.subtract(b, a)
    t = 0.0 if not d.any() else max(0.0, min(1.0, float(np.dot(np.subtract((x, y), a), d) / np.dot(d, d))))
    return float(np.hypot(*(np.add(a, t * d) - (x, y))))


def test_piles_of_polygons_leave_few_rows_a_bin(spark):
    """300 polygons over each other, most of them alike or beneath a smaller id that covers the bin; the smallest id still counts."""
    ring = lambda x, y, a: [(x + a, y), (x, y + a), (x - a, y), (x, y - a), (x + a, y)]
    rows = [(k, "a", "tn", [ring(50.0 + 3 * (k % 2), 50.0, 20.0 + k % 3) if k % 7 else ring(50.0, 50.0, 60.0)]) for k in range(10, 310)]
    rows += [(400 + k, "b", "tn", [ring(50.0, 50.0, 61.0 + k / 8)]) for k in range(200)]
    polys = spark.createDataFrame(rows, "poly_id long, attr string, region string, rings array<array<struct<x: double, y: double>>>")
    bins = vectors.parity_bins(polys, 10.0)
    assert bins.groupBy("bin_x", "bin_y").count().agg(F.max("count")).first()[0] > 250
    few = vectors.least_bins(bins)
    assert few.where("bin_x BETWEEN 3 AND 6 AND bin_y BETWEEN 3 AND 6").groupBy("bin_x", "bin_y").count().agg(F.max("count")).first()[0] <= 7
    points = [(i, 0.37 + i * 7.3 % 100, 0.41 + i * 3.7 % 100) for i in range(300)]
    got = {r.k: r.poly_id for r in vectors.containing(spark.createDataFrame(points, "k long, x double, y double"), polys, "k", 10.0).collect()}
    hold = lambda r, x, y: abs(x - (r[0][0] + r[2][0]) / 2) + abs(y - r[0][1]) < r[0][0] - r[1][0]
    want = {k: min(ids) for k, x, y in points if (ids := [p[0] for p in rows if hold(p[3][0], x, y)])}
    assert got == want
    mask = vectors.masked(spark.createDataFrame(points, "k long, x double, y double"), polys, ["k"], 10.0)
    assert sorted(r.k for r in mask.collect()) == sorted(want)


def test_equal_shapes_are_repaired_once(spark, monkeypatch):
    bow = [(0.0, 0.0), (3.0, 3.0), (3.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    rows = [(k, [[bow]]) for k in range(5, 45)] + [(99, [[[(x + 9.0, y) for x, y in bow]]]), (100, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])]
    seen, cuts = [], repair.cuts
    monkeypatch.setattr(repair, "cuts", lambda e: (seen.append(e.select("poly_id").distinct().count()), cuts(e))[1])
    got = {r.poly_id: r for r in repair.repaired(spark.createDataFrame(rows, f"poly_id long, parts {repair.PARTS}")).collect()}
    assert seen == [3] and len(got) == 42
    assert all(got[k].rings == got[5].rings and got[k].changed for k in range(5, 45)) and got[99].changed and not got[100].changed


def test_equal_polygons_count_as_one(spark):
    """Of polygons with the same rings the smallest id is left. Rows of one id are one polygon, so an id with a ring twice holds nothing there."""
    rows = [(k, "a", "tn", [box(0.0, 0.0, 10.0, 10.0), box(2.0, 2.0, 4.0, 4.0)][:: 1 if k % 2 else -1]) for k in range(5, 205)]
    rows += [(1, "b", "tn", [box(0.0, 0.0, 10.0, 10.0)]), (1, "b", "tn", [box(0.0, 0.0, 10.0, 10.0)]), (2, "c", "tn", [box(20.0, 0.0, 30.0, 10.0)]), (2, "c", "tn", [box(24.0, 0.0, 30.0, 10.0)])]
    rows += [(3, "d", "tn", [box(20.0, 0.0, 30.0, 10.0)])]
    polys = spark.createDataFrame(rows, RINGS)
    assert {r.poly_id: (r.attr, len(r.rings)) for r in vectors.alike(polys).collect()} == {1: ("b", 2), 2: ("c", 2), 3: ("d", 1), 5: ("a", 2)}
    points = spark.createDataFrame([(1, 1.1, 1.2), (2, 3.1, 3.3), (3, 22.1, 3.3), (4, 26.1, 3.3), (5, 15.0, 5.1)], "k int, x double, y double")
    found = vectors.located(points, polys, "k", 6.0, 7.0)
    assert {r.k: (r.poly_id, r.fallback) for r in found.collect()} == {1: (5, False), 2: (5, True), 3: (2, False), 4: (3, False), 5: (1, True)}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
