import random

import public_tokenizers

from hyphaspark.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "é", "日", "😀", "123", " of", " in", ".", "<s>", "\u0000"]


def test_chunks_like_whole():
    p, stable = token_counts.model(PATH)
    assert stable
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["x" * 5000, " " * 5000, "日本" * 2000, "ab " * 2000 + "q" * 3000 + " z" * 500, "\n" * 2000]
    for text in texts:
        for chunk, overlap in ((16, 4), (37, 8), (64, 2)):
            assert token_counts.count_long(text, PATH, chunk, overlap) == len(p.encode(text))


def test_rows(spark):
    p, _ = token_counts.model(PATH)
    rows = [(1, None), (2, ""), (3, "Hé  llo"), (4, "word " * 9000), (4, "word " * 9000), (None, "x"), (5, "y" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_tokens")
    want = [(i, len((t or "").encode()), len(p.encode(t or "")), len(p.encode(t or "")) > 4096) for i, t in rows]
    key = lambda r: (r[0] is None, r)
    for chunk in (token_counts.CHUNK, 100):
        assert sorted((tuple(r) for r in token_counts.count_tokens(df, PATH, chunk=chunk).collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_documents_take_chunks(spark):
    """Whole documents of the given tables: those beyond a chunk are spliced, and count as the library counts."""
    p, _ = token_counts.model(PATH)
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(f"length(text) > {token_counts.CHUNK + token_counts.OVERLAP}").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    out = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PATH).collect()}
    assert len(texts) > 100 and out == {i: len(p.encode(t)) for i, t in texts.items()}
