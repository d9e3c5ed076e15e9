import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from hyphaspark.llm import pii

SF = "/root/testdata/sf0.001"


def brute_base(text):
    """The contract's patterns as they stand."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def sound(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            n = int(c) * (1 + k % 2)
            total += n - 9 * (n > 9)
        return total % 10 == 0

    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and sound(digits(m))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


PIECES = ["a", "B7", "@", ".", "x.y", "1", "25", "255", "256", "001", " ", "-", "+", "(", ")", "+1 555", "4111 1111 1111 1111", "5500-0000-0000-0004", "é", "日", "%", "_", "me@x.org", "1.2.3.4", "\n", " dot ", "(at)", "٣"]


def test_base_like_patterns():
    rng = random.Random(2)
    hits = 0
    for _ in range(20000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        got = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]
        assert got == brute_base(text), text
        hits += len(got)
    assert hits > 2000


def paths(n, spots):
    """Every segmentation of a chain: lists of (segment or None, kind)."""

    def onward(k):
        if k == n:
            yield []
            return
        for rest in onward(k + 1):
            yield [(None, -1), *rest]
        for s, (i, j) in enumerate(spots):
            if i == k:
                for rest in onward(j):
                    for y in range(len(pii.KINDS)):
                        yield [(s, y), *rest]

    return list(onward(0))


def test_sums_and_best_path_like_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 6))
        spots = sorted((int(i), int(j)) for i, j in itertools.combinations(range(n + 1), 2) if rng.random() < 0.5)
        scores, follows = rng.normal(0, 2, (len(spots), 4)), rng.normal(0, 1, (5, 5))
        all_paths, totals = paths(n, spots), []
        for path in all_paths:
            label, total = 0, 0.0
            for s, y in path:
                total += follows[label, y + 1] + (scores[s, y] if s is not None else 0)
                label = y + 1
            totals.append(total)
        p = np.exp(np.array(totals) - np.logaddexp.reduce(totals))
        chance, pairs = np.zeros((len(spots), 4)), np.zeros((5, 5))
        for path, weight in zip(all_paths, p):
            label = 0
            for s, y in path:
                pairs[label, y + 1] += weight
                label = y + 1
                if s is not None:
                    chance[s, y] += weight
        total, got_chance, got_pairs = pii.expectations(n, spots, scores, follows)
        assert np.isclose(total, np.logaddexp.reduce(totals)) and np.allclose(got_chance, chance) and np.allclose(got_pairs, pairs)
        best = [x for x in all_paths[int(np.argmax(totals))] if x[0] is not None]
        assert pii.decode(n, spots, scores, follows) == best


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(docs):
    return pii.train(docs)


def test_held_out_forms(model, spark):
    """Written forms between words of other documents than those trained on."""
    other = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 50 = 7").select("text").collect()]
    words = [x[a:b] for x in other if x for a, b in pii.windows(x)]
    hit = made = wanted = 0
    for text, gold in pii.examples(words, 1500, seed=77)[len(words) :]:
        got = {(k, a, b) for k, a, b, _ in pii.all_spans(text, model)}
        hit, made, wanted = hit + len(got & set(gold)), made + len(got), wanted + len(gold)
    assert wanted > 800 and hit / made >= 0.96 and hit / wanted >= 0.96


PLANTED = [("write to jane.doe (at) mail dot org today", "email", "jane.doe (at) mail dot org"), ("call (523) 555-0134 now", "phone", "(523) 555-0134"), ("server 10[.]20[.]30[.]40 is up", "ip", "10[.]20[.]30[.]40"), ("paid with 4111.1111.1111.1111 then", "card", "4111.1111.1111.1111"), ("la +1 (826) 555-4081 190.137.20.4 de", "phone", "+1 (826) 555-4081")]
CLEAN = ["", "no numbers here at all.", "Version 2.0. of 2024-11-28, 12:30:55", "we met at the dot of noon", "number 4111111111111112 is no card", "under CC BY-NC 4.0.", "a | 12 | 345 | 6789", "see www.example.com"]


def test_table(spark, model):
    texts = [x[0] for x in PLANTED] + CLEAN + [None, "a@b.cd a@b.cd", "a@b.cd a@b.cd"]
    df = spark.createDataFrame([(None if i == 3 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = pii.find(df, model)
    rows = sorted((tuple(r) for r in pii.digest(found).collect()), key=lambda r: (r[0] is None, r[0]))
    assert len(rows) == len(texts)
    by = {3 if r[0] is None else r[0]: r for r in rows}
    for i, (text, kind, part) in enumerate(PLANTED):
        at = text.index(part)
        assert f"{kind}:{at}:{at + len(part)}" in by[i][6].split(","), (text, by[i])
    for i, text in enumerate(texts):
        base = brute_base(text or "")
        assert by[i][1:5] == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        assert by[i][5] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(by[i][6].split(","))
        if i >= len(PLANTED) and i < len(PLANTED) + len(CLEAN):
            assert by[i][6] == ""
    clean = pii.redact(df, model)
    assert clean.columns == df.columns and {r.text for r in clean.where("text LIKE '%[%'").collect()} >= {"write to [email] today", "call [phone] now", "server [ip] is up", "[email] [email]"}
    assert pii.digest(pii.find(df.limit(0), model)).collect() == []
    assert pii.train(df.limit(0)).index


def test_documents(docs, model):
    """Whole documents: base counts and digests as by the patterns; documents without digits, at signs and dots have no spans."""
    rows = {r.doc_id: r for r in pii.digest(pii.find(docs, model)).collect()}
    n = 0
    for r in docs.collect():
        base, out = brute_base(r.text or ""), rows[r.doc_id]
        assert out.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        n += len(base)
        if not re.search(r"[0-9@]", r.text or ""):
            assert out.spans == ""
    assert n > 50


def test_long_texts(model):
    for text in ("9" * 10**6, "a" * 10**6 + "@", "@" * 10**5, "+1" * 10**5, "1." * 10**4, "1 " * 10**4, "a.b@" * 10**4, "(at) dot " * 10**4, "x" * 10**6 + "1.2.3.4", "4111 1111 1111 1111, " * 3000):
        start = time.time()
        pii.all_spans(text, model)
        assert time.time() - start < 40, text[:10]
