import math

from hyphaspark.llm import mixing


def shares(sizes):
    """Targets by resharing the excess until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3 * sizes[s] for s in over}


def test_plan(spark):
    rows = []
    for i in range(600):
        source = ["hot", "hot", "hot", "a", "Ä", None][i % 6] if i < 500 else f"s{i % 7}" if i < 540 else "tiny"
        rows.append((i, None if i % 50 == 0 else "w " * (i % 37), source))
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 543] + [(7, "a b", "a"), (7, "a b", "a"), (None, "x y z", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0L AS size", "1 AS target").repartition(5)
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    sizes, want = {}, None
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = shares(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, want[s]) and r.taken == r.copies * r.size <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert all(len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions) for r in own)
    again = mixing.plan(df.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.positions)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.plan(df.limit(0)).collect() == []
    taken = mixing.training_order(df)
    assert taken.columns == df.columns
    assert sorted(r.doc_id for r in taken.where("doc_id IS NOT NULL").collect()) == sorted(r.doc_id for r in got for _ in range(r.copies) if r.doc_id is not None)
    place = {r.doc_id: r.positions for r in got if r.doc_id not in (None, 7)}
    order = [r.doc_id for r in taken.where("doc_id <> 7").collect()]
    spots, last = {i: iter(p) for i, p in place.items()}, -1.0
    for i in order:
        at = next(spots[i])
        assert at >= last
        last = at


def test_schedule_inverse(spark):
    for slope in (-0.5, 0.0, 0.5):
        for part in (0.0, 0.1, 0.5, 1.0):
            t = spark.range(1).select(mixing.time_of(mixing.F.lit(part), mixing.F.lit(slope)).alias("t")).first().t
            assert math.isclose(t * (1 - slope) + slope * t * t, part, abs_tol=1e-12)
