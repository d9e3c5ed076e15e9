import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hyphaspark.llm import mixing

from .test_ngram_join import brute as components
from .test_quality_rules import brute as counts

WORDS = {"de": "der die und nicht schule zwischen über straße garten himmel".split(), "fr": "le la et très beau où élève garçon jardin ciel".split()}


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(12), []
    for i in range(160):
        lang = rng.choice(["de", "fr"])
        text = " ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 99)) for _ in range(rng.randint(12, 80)))
        out.append((i, text, lang, rng.choice(["hot", "hot", "a", "b"]), len(text)))
    out += [(200 + i, out[i][1], "de", "hot", 0) for i in range(20)]  # copies
    out += [(300 + i, out[i][1] + " ende", "de", "a", 0) for i in range(20)]  # near copies
    out += [(400, None, None, None, None), (401, "", "de", "a", 0), (402, "12 34 !!", "de", "a", 0), (403, "zu kurz", "de", "a", 0), (404, "schule " * 200, "de", "a", 0)]
    return out


def test_stages(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    docs = source = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == source.columns
        docs = docs.cache()
        kept.append(docs.collect())
    ids = [{r.doc_id for r in k} for k in kept]
    texts = {r[0]: r[1] for r in rows}
    assert ids[0] == {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert ids[1] == {i for i in ids[0] if not counts(texts[i])[5]} and 404 not in ids[1] and 403 not in ids[1]
    assert sorted(ids[2]) == sorted({least for _, _, least in components([(i, texts[i]) for i in ids[1]], 5, 80)}) and len(kept[2]) == len(ids[2])
    planned = mixing.plan(spark.createDataFrame(kept[2], source.schema)).collect()
    assert sorted(r.doc_id for r in kept[3]) == sorted(r.doc_id for r in planned for _ in range(r.copies))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept[3])
    assert all(np.frombuffer(r.ids, "<u4").tolist() == own.encode(texts[r.doc_id], add_special_tokens=False).ids for r in out)


def test_edges(spark, tmp_path):
    """Null and repeated ids, several texts under one id, clashing columns, an empty table."""
    rng = random.Random(3)
    text = lambda n=30: " ".join(rng.choice(WORDS["de"]) + str(rng.randint(0, 99)) for _ in range(n))
    a, b, c = text(), text(), text(60_000)
    rows = [(1, a), (1, a), (2, a + " ende"), (2, b), (None, b), (None, text()), (3, None), (3, ""), (4, c), (5, text())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, _text int, token long, size double, position int"
    made = [(i, t, "de", s, 1, "r", 2, 3, 4.0, 5) for (i, t), s in zip(rows, ["x", "x", None, "y", "x", None, "x", "y", "y", "y"], strict=True)]
    docs = spark.createDataFrame(made, schema).repartition(3)
    for name, df in (("some", docs), ("none", docs.limit(0))):
        path = f"{tmp_path}/{name}"
        df.write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, path).cache()
            assert docs.columns == df.columns
            if stage == "near_duplicates" and name == "some":
                kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
                assert kept == sorted([(1, a), (2, b), (None, rows[5][1]), (4, c), (5, rows[9][1])], key=str)
        assert (corpus_pipeline.run(spark, path).count() > 0) == (name == "some")


def test_one_copy_of_the_texts_is_left(spark):
    """Whatever the stages write on their way, the folder ends with the input of the last one alone."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("mix-") and out.count() > 0
