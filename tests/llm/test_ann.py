import numpy as np
import pytest
from pyspark.sql import functions as F

from hyphaspark.llm import ann


def brute(vectors, k=5, step=50):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cosine = lambda a, b: (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    return {q: sorted((-cosine(v, ok[q]), i) for i, v in ok.items() if i != q)[:k] for q in ok if q % step == 0}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x[1000:1400] = x[0] + rng.normal(size=(400, 64)) * 0.02  # near copies
    x[2000:2300] = x[50]  # copies: ties go to the smaller id
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS bucket").repartition(4)
    out = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute(rows)
    assert set(out) == set(want) and all(len(v) == 5 for v in out.values())
    hits = sum(len({i for _, i in out[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for _, i in out[50]] == [2000, 2001, 2002, 2003, 2004]
    every = {i: np.array(v) for i, v in rows}
    for q, v in out.items():
        for s, i in v:
            a, b = every[q], every[i]
            assert abs(-s - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (None, [1.0, 2.0, 3.0]), (7, []), (50, [-1.0, 0.0, 0.0]), (50, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def found(df, step=50, **options):
    out = {}
    for r in ann.search(df, F.col("vec_id") % step == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_hadamard():
    for width in (1, 2, 8, 64, 128):
        m = ann.hadamard(np.eye(width, dtype=np.float32))
        assert np.allclose(m @ m.T, np.eye(width), atol=1e-5) and np.allclose(np.abs(m), width**-0.5, atol=1e-5)


def test_probes_are_the_nearest():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 5, 8)).astype(np.float32)
    got = ann._probed([x, y], 20)
    for q in range(5):
        gaps = [[(max(abs(v)) - c) ** 2 for c in [*v, *-v]] for v in (x[q], y[q])]
        costs = np.add.outer(*gaps).ravel()
        assert np.allclose(costs[got[q]], np.sort(costs)[:20], atol=1e-5) and len(set(got[q])) == 20
    assert (got[:, 0] == ann._bucket([x, y])).all()


def test_plans_of_other_tables():
    """Neighbours as far as in tables of other sizes and widths: more rows take more hashes, not less recall."""
    few, many, copies = (ann.plan(np.full(5, c), 64, 64, n, n // 50) for c, n in ((0.4, 10_000), (0.72, 10**9), (0.95, 10**9)))
    assert all(p["found"] >= ann.WANTED for p in (few, many, copies))
    assert few["functions"] == 1 and many["functions"] > 1 and max(many["scanned"], copies["scanned"]) < 0.01
    assert ann.plan(np.full(5, 0.11), 1024, 768, 6000, 120) is None


@pytest.mark.parametrize("dims,functions", [(64, None), (64, 2), (128, None), (256, None)])
def test_recall_without_structure(spark, dims, functions):
    """Random vectors are the hardest case, whatever their width and the number of hashes."""
    rng = np.random.default_rng(dims)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(3000, dims)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    setting = {"functions": 2, "tables": 16, "probes": 500} if functions else None
    out, want = found(df, 100, setting=setting), brute(rows, step=100)
    assert set(out) == set(want) and all(len(v) == 5 for v in out.values())
    assert sum(len(set(out[q]) & {i for _, i in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: [i for _, i in v] for q, v in brute(rows, step=3).items()}
    assert found(df, 3, setting={"functions": 1, "tables": 2, "probes": 16}) == want
    monkeypatch.setattr(ann, "WANTED", 1.1)  # no setting: all rows, in blocks
    assert found(df, 3) == want


def test_copies(spark):
    """A third of all rows is one vector: ids decide, and every copy asks."""
    rng = np.random.default_rng(6)
    same = [0.3, -0.2, 0.9, 0.1]
    rows = [(i, same if i % 3 == 0 else [float(c) for c in rng.normal(size=4)]) for i in range(300)]
    rows += [rows[0], (6, [9.0, 9.0, 9.0, 9.0])]  # a repeated row; one id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = found(df, 2)
    assert [out[k] for k in (0, 12, 240)] == [[3, 6, 9, 12, 15], [0, 3, 6, 9, 15], [0, 3, 6, 9, 12]]
    assert len(out) == 150 and all(len(v) == 5 and q not in v for q, v in out.items())


@pytest.mark.parametrize("weight", [0.0, 1.0, 1.5, 3.0])
def test_vectors_that_share_a_direction(spark, weight):
    """A common mean, as embeddings have it, neither crowds the buckets nor costs recall; the plan knows how much is compared."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    common = rng.normal(size=64)
    x = (x + weight * common / np.linalg.norm(common)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    packed = df.select("vec_id", "embedding").mapInArrow(ann._packer(64, "<f4"), "vec_id long, vec binary").withColumnRenamed("vec_id", "id").cache()
    mean, q = ann._mean(packed, 64, "<f4"), x[::50].astype(np.float64)
    units = ann._units(x.astype(np.float64), mean)
    near = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(near[::50] @ near.T), axis=1)[:, 1:6]
    cosines = (units[::50][:, None, :] * units[order]).sum(2).ravel()
    assert np.allclose(np.sort(ann._sampled(packed, q, np.arange(0, 6000, 50), mean, 64, "<f4", 5)), np.sort(cosines), atol=1e-4)
    setting = ann.plan(cosines, 64, 64, 6000, 120, ann._met(packed, q, mean, 64, "<f4", 6000, 11))
    scanned = 0.0
    for rotated in ann._rotations(units, setting["tables"], setting["functions"], 11):
        buckets, counts = np.unique(ann._bucket(rotated), return_counts=True)
        held = dict(zip(buckets.tolist(), counts.tolist()))
        scanned += np.mean([sum(held.get(b, 0) for b in row) for row in ann._probed([r[::50] for r in rotated], setting["probes"]).tolist()]) / 6000
    assert scanned <= 1.5 * setting["scanned"] and setting["scanned"] < 1, (scanned, setting)
    got = found(df)
    want = {q: set((order[q // 50]).tolist()) for q in range(0, 6000, 50)}
    assert sum(len(set(got[q]) & w) for q, w in want.items()) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("dims", [256, 512])
def test_hashing_of_wide_vectors(spark, dims):
    """Recall of the hashing itself, where neighbours are near enough for a plan."""
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(400, dims))
    x = (np.repeat(centres, 8, 0) + 0.6 * rng.normal(size=(3200, dims))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    near = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(near[::50] @ near.T), axis=1, kind="stable")[:, 1:6]
    cosines = np.sort((near[::50][:, None, :] * near[order]).sum(2).ravel())
    setting = ann.plan(cosines, dims, dims, 3200, 64)
    assert setting and setting["scanned"] < 0.5
    got = found(df, setting=setting)
    assert sum(len(set(got[q]) & set(order[q // 50].tolist())) for q in range(0, 3200, 50)) >= 0.9 * 5 * 64
