import random

import numpy as np
import pyarrow as pa

from hyphaspark.llm import language_id

WORDS = {"de": "der die und nicht schule zwischen über straße".split(), "fr": "le la et très beau où élève garçon".split(), "ru": "и не что школа между улица".split()}


def test_viterbi_like_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(40):
        sizes = rng.integers(0, 8, 5)
        at, k, cost = np.concatenate([[0], np.cumsum(sizes)]), 3, 1.5
        scores = rng.normal(size=(at[-1], k)).round(3)
        got = language_id.viterbi(scores, at, cost, run=int(rng.integers(1, 5)))
        value = lambda labels, s: s[np.arange(len(s)), labels].sum() - cost * np.count_nonzero(np.diff(labels))
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi > lo:
                every = np.stack(np.meshgrid(*[range(k)] * (hi - lo), indexing="ij"), -1).reshape(-1, hi - lo)
                assert np.isclose(value(got[lo:hi], scores[lo:hi]), max(value(e, scores[lo:hi]) for e in every))


def test_runs_make_no_difference():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 900, 12)
    at = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(at[-1], 4)) * rng.choice([0.2, 1.0], (at[-1], 1))
    whole = language_id.viterbi(scores, at, 3.0, run=1000)
    assert all(np.array_equal(whole, language_id.viterbi(scores, at, 3.0, run=r)) for r in (1, 7, 64, 899))


def test_pieces_make_no_difference(monkeypatch):
    model = {"langs": ["a", "b"], "scripts": np.full(2, 0xFFFFFFFF, np.uint32), "tables": np.random.default_rng(1).normal(size=(2, 1 << language_id.BITS, 2)).astype(np.float32)}
    text = pa.array(["été là " * 9000, "x", "no gap" * 9000, " \n" * 40000 + "end"])
    whole = list(language_id._verdicts(text, model))
    monkeypatch.setattr(language_id, "PIECE", 1 << 16)
    parts = [v for v in language_id._verdicts(text, model)]
    flat = lambda rows: [x for _, langs, score in rows for x in zip(langs, score, strict=True)]
    assert flat(whole) == flat(parts)


def test_identify(spark):
    rng = random.Random(8)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 60)), lang) for i, lang in enumerate(["de", "fr", "ru"] * 60)]
    df = spark.createDataFrame([*rows, (900, None, "de"), (901, "zu", None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    model = language_id.train(df.where(~language_id.held_out()))
    tests = [(1, text("ru", 8) + " " + text("de", 12), "x"), (2, None, "x"), (3, "", "x"), (4, "12 !?", "x"), (None, text("fr", 5), "x"), (5, text("de", 9000), "x")]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, None, 5)] == ["de", "und", "und", "und", "fr", "de"]
    assert all(0 <= r.score <= 1 for r in out.values()) and out[5].score > 0.99
    spans = [tuple(r) for r in language_id.label_spans(spark.createDataFrame(tests[:1], "doc_id long, text string, lang string"), model).collect()]
    assert spans == [(1, 0, 8, "ru"), (1, 8, 12, "de")]
    strange = spark.createDataFrame([(1, "ελληνικά γράμματα"), (2, text("de", 3) + " γράμματα")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.identify(strange, model).collect()}
    assert found[1].lang_pred in WORDS and found[1].score == 0 and 0 < found[2].score < 1  # letters of no learned language
    assert [r.doc_id for r in language_id.keep(strange, model).collect()] == [2]
    held = df.where(language_id.held_out()).where("lang IS NOT NULL AND text IS NOT NULL")
    assert language_id.identify(held, model).join(held, "doc_id").where("lang <> lang_pred").count() == 0
    assert language_id.identify(df.limit(0), model).collect() == []
    nothing = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
