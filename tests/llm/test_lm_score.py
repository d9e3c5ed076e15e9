import math
import random
from collections import Counter

from hyphaspark.llm import lm_score


def test_like_brute_force(spark):
    rng = random.Random(10)
    good = [f"g{i}" for i in range(20)]
    bad = [f"b{i}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "Never seen words"), (None, "G1 g2"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score").repartition(3)
    labels = spark.createDataFrame([(i,) for i in range(0, 200) if i % 3] + [(None,)], "doc_id long")
    model = lm_score.train(df, labels)
    out = {(r.doc_id, r.n_tokens): r for r in lm_score.score(df, model).collect()}
    chosen = {r.doc_id for r in labels.collect()} - {None}
    words = lambda t: (t or "").lower().split()
    every = Counter(w for _, t in rows for w in words(t))
    size = len(every) + 2

    def build(texts):
        c1, c0, c2 = Counter(), Counter(), Counter()
        for t in texts:
            before = "<s>"
            for w in words(t):
                c1[w] += 1
                c0[before] += 1
                c2[before, w] += 1
                before = w
        return c1, c0, c2

    target, background = build(t for i, t in rows if i in chosen), build(t for _, t in rows)
    for i, t in rows:
        loss = []
        for c1, c0, c2 in (target, background):
            total, before = 0.0, "<s>"
            for w in words(t):
                p = (c1[w] + 1) / (sum(c1.values()) + size)
                total -= math.log((c2[before, w] + lm_score.MU * p) / (c0[before] + lm_score.MU))
                before = w
            loss.append(total / max(1, len(words(t))))
        r = out[i, len(words(t))]
        assert math.isclose(r.target_loss, loss[0], rel_tol=1e-3, abs_tol=1e-6) and math.isclose(r.background_loss, loss[1], rel_tol=1e-3, abs_tol=1e-6)
    assert out[900, 0].score == 0
    scores = {i: r.score for (i, n), r in out.items() if n > 5 and i is not None and i < 300}
    assert max(s for i, s in scores.items() if i % 3) < min(s for i, s in scores.items() if i % 3 == 0)
    assert lm_score.score(df.limit(0), model).collect() == []
    assert len(lm_score.score(df, lm_score.train(df.limit(0), labels.limit(0))).collect()) == len(rows)


def test_counts_grow_with_the_corpus(spark, monkeypatch):
    """More words and pairs than the former 2^15 words and 2^19 buckets, more blocks than one, more labelled
    documents than the former 20,000: every word, pair and label counts."""
    monkeypatch.setattr(lm_score, "BLOCK", 1 << 20, raising=False)
    rng = random.Random(7)
    rows = [(i, " ".join([f"w{rng.randrange(300_000)}" for _ in range(24)] + ["all", "of", "them"])) for i in range(30_000)]
    labels = [i for i in range(30_000) if i % 6]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    model = lm_score.train(df, spark.createDataFrame([(i,) for i in labels], "doc_id long"))
    counts = []
    for chosen in (set(range(30_000)), set(labels)):
        c1, c0, c2 = Counter(), Counter(), Counter()
        for i, t in rows:
            if i in chosen:
                w = t.split()
                c1.update(w)
                c0.update(["<s>", *w[:-1]])
                c2.update(zip(["<s>", *w[:-1]], w, strict=True))
        counts.append((c1, c0, c2, sum(c1.values())))
    size = len(counts[0][0]) + 2
    assert size > 1 << 17 and len(counts[0][2]) > 1 << 19 and len(labels) > 20_000
    other = df.where("doc_id < 500").repartition(2)  # rows that are not those of the model
    for got, n in ((lm_score.score(df, model).collect(), len(rows)), (lm_score.score(other, model).collect(), 500)):
        assert len(got) == n
        by_id = {r.doc_id: r for r in got}
        for i, t in rows[:500]:
            w = t.split()
            for (c1, c0, c2, total), loss in zip(counts, (by_id[i].background_loss, by_id[i].target_loss), strict=True):
                want = sum(math.log(c0[v] + lm_score.MU) - math.log(c2[v, x] + lm_score.MU * (c1[x] + 1) / (total + size)) for v, x in zip(["<s>", *w[:-1]], w, strict=True))
                assert math.isclose(loss, want / len(w), rel_tol=1e-9)
