import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hyphaspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "th", "ing", " ", "\n", "'s", "'", "É", "é", "é", "Σ", "ς", "İ", "ﬁ", "漢", "😀", "👍🏽", "1", "23", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\x85", "　", "aaaa", "ƒ", "ß"]


def test_like_the_library(spark):
    own, rng = Tokenizer.from_file(PATH), random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", "x" * 20_000, "ab " * 30_000, "aab" * 5_000, "same", "same"]
    rows = [*enumerate(texts), (None, "no id"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens").repartition(3)
    encoded = bpe.encode(df, PATH)
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in encoded.collect()}
    want = {i: own.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert got == {i: (len(w), np.array(w, "<u4").tobytes()) for i, w in want.items()}
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, PATH).collect()} == {i: own.decode(w, skip_special_tokens=False) for i, w in want.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH).collect()} == {(i, sha(np.array(w, "<u4").tobytes()), sha(own.decode(w, skip_special_tokens=False).encode())) for i, w in want.items()}
    assert bpe.round_trip(df.limit(0), PATH).collect() == []


def test_out_of_order_merges():
    """A merge that an earlier rank can use is applied one position a word at a time."""
    v = object.__new__(bpe.Vocabulary)
    v.inner, v.last = np.arange(256, dtype=np.int64), np.arange(256, dtype=np.int64)
    merges = [(97, 98, 300), (300, 99, 301), (98, 99, 302), (97, 302, 300), (300, 300, 303)]  # 300 is made twice
    v.keys = np.array(sorted(a << 20 | b for a, b, _ in merges), np.int64)
    rank = {a << 20 | b: r for r, (a, b, _) in enumerate(merges)}
    v.ranks = np.array([rank[k] for k in v.keys.tolist()], np.int64)
    v.left, v.right, v.made = (np.array(x, np.int64) for x in zip(*merges, strict=True))
    v.single = {3}

    def plain(word):
        s = list(word.encode())
        while True:
            found = [(rank[a << 20 | b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a << 20 | b in rank]
            if not found:
                return s
            r, i = min(found)
            s[i : i + 2] = [merges[r][2]]

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    ids, at = bpe.merge_words(words, v)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(words))] == [plain(w) for w in words]
