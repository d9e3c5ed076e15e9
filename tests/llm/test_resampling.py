import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyphaspark.llm import resampling as rs


def runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in runs(t)[1])
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10000)]
    out = []
    for i, text in docs:
        words, found = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


ALPHABET = ["the", "The", "of", "été", "日本", "x1", "A-b", "a.b", "\x00", "é", "_", "longword" * 9, "Q" * 33, "z" * 32, "9"]


@pytest.mark.parametrize("part_rows", [4, 1 << 13])
def test_like_definition(spark, part_rows):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "word " * 30000), (None, "no id " * 20), (None, "no id " * 20), (None, None), (503, "y" * 100000)]
    docs += [(7, "equal rows stay apart " * 8)] * 90
    target = ["The word été of target x1 x1", None, "", "equal rows"]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(9)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60, 100):
        made = rs.resample(df, aim, percent=percent, part_rows=part_rows)
        assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in made.collect()), key=str) == brute(docs, target, percent)
    assert rs.resample(df.limit(0), aim).collect() == []
    assert rs.resample(df, aim.limit(0), part_rows=part_rows).where("rank IS NOT NULL").count() == len([d for d in docs if len(runs(d[1])[0]) >= 20]) * 5 // 100


def test_crc_of_runs():
    text = ("Aé b " + "q" * 70 + " 日本語 c" + "d" * 40 + " e") * 3
    data = np.frombuffer(text.encode() + b"zz other text", np.uint8)
    offsets = np.array([0, 0, len(text.encode()), len(data)])
    n_words, made = rs.features(data, offsets)
    for n, (found, at) in enumerate(made, 1):
        want = [[zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for i in range(len(w) - n + 1)] for w in (runs(t)[0] for t in ("", text, "zz other text"))]
        assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert n_words.tolist() == [len(runs(t)[0]) for t in ("", text, "zz other text")]


def test_parts_are_even(spark):
    """Splitters from regular samples bound every part, with a third of the rows of one score and id."""
    rng = np.random.default_rng(1)
    n = 40000
    score = np.where(np.arange(n) % 3 == 0, 5, rng.integers(-1000, 1000, n))
    keys = spark.createDataFrame(list(zip((-score).tolist(), [9 if i % 3 == 0 else i for i in range(n)], range(n))), "_down long, _id long, _row long").repartition(13)
    found = rs.splitters(keys, 20)
    rows = np.array(sorted(map(tuple, keys.collect())))
    part = found.part(rows[:, 0], rows[:, 1], rows[:, 2])
    assert (np.diff(part) >= 0).all() and len(found.down) == 19
    assert np.bincount(part).max() <= 1.5 * n / 20


def test_drawn_texts(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 25, "k") for i in range(40)], "doc_id long, text string, rank string")
    made = rs.resample(df, df.limit(3))
    out = rs.texts(df, made).collect()
    assert [r.drawn_rank for r in sorted(out, key=lambda r: r.drawn_rank)] == [1, 2] and all(r.rank == "k" and f"word{r.doc_id} " in r.text for r in out)
    assert rs.ranked(df.select("doc_id", F.col("doc_id").alias("score"), F.col("doc_id").alias("_row")), F.lit(True), lambda n: 0).where("rank IS NOT NULL").count() == 0
