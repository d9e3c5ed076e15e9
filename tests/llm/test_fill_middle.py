import hashlib
import random
import re

import pytest
import zstandard

from hyphaspark.llm import fill_middle as fim


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)


def brute(doc_id, text):
    """Form, prefix, middle and suffix, and the output, from the definition."""
    u = units(text)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


PIECES = ["a", "Zz", "word", " ", "\n", "\r\n", "é", "ß", "日", "😀", "<", "P>", "<P", ">", "<S", "M", "\x00", "1", "_", "é"]


def rows():
    rng = random.Random(5)
    made = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 200)))) for i in range(300)]
    made += [(1000 + i, "x" * 500 if i % 2 else "日本 a" * 100) for i in range(20)]
    made += [(2000, None), (2001, ""), (2002, "<P>"), (2003, "a<M>b"), (2003, "a<M>b"), (None, "some text here"), (None, None), (2004, "plain words " * 20000), (2005, "z" * 300000)]
    return made


@pytest.mark.parametrize("size", [3, 16, 1 << 16])
def test_like_definition(spark, size):
    data = rows() if size > 3 else [r for r in rows() if len(r[1] or "") < 1000]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, n int, form string")
    out = fim.transform(fim.plan(fim.store(df, frame_bytes=size)), frame_bytes=size)
    got = sorted((tuple(r) for r in fim.digests(out).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in data:
        n, form, p, m, text = brute(i, t or "")
        want.append((i, n, form, p, m, sha(text), sha(t or "")))
    assert got == sorted(want, key=str)
    again = {str(tuple(r)) for r in fim.texts(out, restore=True).select("doc_id", "text").collect()}
    assert again == {str((i, t or "")) for i, t in data}
    assert {r.text for r in fim.texts(out).collect()} == {brute(i, t or "")[4] for i, t in data}
    assert fim.digests(fim.transform(fim.plan(fim.store(df.limit(0))))).collect() == []


def test_seek_opens_one_frame(spark):
    """A cut opens only the frame in which its unit starts."""
    text = "word and 1234 日本語 " * 5000
    row = fim.store(spark.createDataFrame([(1, text)], "doc_id long, text string"), frame_bytes=1000).first()
    reader = fim.Reader([f.asDict() for f in row.frames], zstandard.ZstdDecompressor())
    opened, once = [], reader.open
    reader.open = lambda k: opened.append(k) or once(k)
    u = units(text)
    assert row.n == len(u) and len(row.frames) > 100
    for cut in (0, 1, 777, len(u) // 2, len(u) - 1, len(u)):
        opened.clear()
        k, byte, chars = reader.seek(cut)
        assert len(opened) == (cut < len(u))
        assert chars == len("".join(u[:cut]))
        assert b"".join(reader.stream((k, byte))).decode() == "".join(u[cut:])
