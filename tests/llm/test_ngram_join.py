import os
import random
import re
import types

import numpy as np
import pyarrow as pa

from hyphaspark.llm import ngram_join


def brute(rows, n=4, percent=85):
    sets = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((doc, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two"), (7, long), (8, long + " tail"), (9, long.replace("w150", "x")), (9, long), (10, "a b c d"), (11, "a b c d"), (12, "É b c d"), (13, "é b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_shingles", "2 AS class_key")
    got = sorted(tuple(r)[:3] for r in ngram_join.components(df).collect())
    assert got == brute(rows)
    assert ngram_join.components(df.limit(0)).collect() == []


def test_long_words_differ(spark):
    """A string with much structure and its complement: a polynomial hash modulo 2^64 cannot tell them apart."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, other), (3, word), (4, f"x y z {word} u"), (5, f"x y z {other} u")]
    got = sorted(tuple(r)[:3] for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_deduplicate(spark):
    base = " ".join(f"w{i}" for i in range(200))
    unique = " ".join(f"u{i}" for i in range(200))
    rows = [(3, base), (5, base + " tail"), (5, unique), (5, unique), (None, base), (None, "z1 z2 z3 z4 z5"), (None, "z1 z2 z3 z4 z5"), (7, None), (7, ""), (8, "  ")]
    df = spark.createDataFrame([(i, t, k, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _text int, _gone int, row_key int")
    out = sorted(((r.doc_id, r.text or "") for r in ngram_join.deduplicate(df).collect()), key=str)
    assert out == sorted([(3, base), (5, unique), (None, "z1 z2 z3 z4 z5"), (7, ""), (8, "  ")], key=str)
    assert ngram_join.deduplicate(df).columns == df.columns and ngram_join.deduplicate(df.limit(0)).collect() == []


def test_long_lists(spark, monkeypatch):
    """Shingles with long lists, dealt over many slots."""
    monkeypatch.setattr(ngram_join, "LIST", 5)
    rng = random.Random(2)
    shared_part = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared_part[: rng.randint(50, 60)] + [f"d{rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r)[:3] for r in ngram_join.components(df).collect()) == brute(rows)


def test_large_corpora_deal_no_more(spark):
    """With the load of some 30 GB in every bucket the same prefixes are sent, and only lists beyond it are dealt."""
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(40)])
    few = np.zeros(ngram_join.BUCKETS, np.int64)
    for _, hashes in ngram_join._sets(texts, 4):
        np.add.at(few, hashes >> np.uint64(46), 1)
    hot = next(hashes for _, hashes in ngram_join._sets(texts, 4))
    few[hot >> np.uint64(46)] += 3 * ngram_join.LIST
    sent = []
    for counts in (few, few + 2 * ngram_join.LIST):
        run = ngram_join._prefixes(4, 85, types.SimpleNamespace(value=counts), ngram_join.LIST)
        sent.append(pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))))
    assert sent[0].equals(sent[1])
    slots = sent[1]["slot"].to_numpy()
    assert 0 < np.count_nonzero(slots >= 0) < len(slots) / 10


def test_staged_tables_go(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    ngram_join.deduplicate(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")).collect()
    assert len(set(os.listdir(folder)) - before) == 1  # what the result is read from


def test_like_brute_force(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(25)]
    rows = []
    for i in range(220):
        text = list(base[i % 25])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - i, " ".join(text) + rng.choice(["", " end", " t1 t2"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r)[:3] for r in ngram_join.components(df).collect()) == brute(rows)
    pairs, members = ngram_join.links(df)
    key = {r.doc_id: r.class_key for r in members.collect()}
    sets = {doc: s for doc, s in ((d, frozenset(zip(*[t.split()[k:] for k in range(4)])) or frozenset([tuple(t.split())])) for d, t in rows)}
    want = {tuple(sorted((key[x], key[y]))) for x in sets for y in sets if key[x] != key[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])}
    assert {tuple(sorted(r)) for r in pairs.collect()} == want
