import random
import re

import numpy as np

from hyphaspark.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found, seen, dup, under = {}, set(), 0, set()
    for i in range(len(words) - 4):
        found.setdefault(tuple(words[i : i + 5]), []).append(i)
    for spots in found.values():
        under.update(*(range(i, i + 5) for i in spots)) if len(spots) > 1 else None
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(under), len(words) < 10 or 100 * len(under) > 20 * len(words)


def repeats(words):
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_longest_repeats():
    rng = np.random.default_rng(1)
    for _ in range(100):
        parts = [rng.integers(0, 3, rng.integers(1, 15)) for _ in range(3)]
        got = quality_rules.longest_repeats(np.concatenate(parts).astype(np.uint64), np.repeat([2, 5, 9], [len(p) for p in parts]))
        assert got.tolist() == sum((repeats(list(p)) for p in parts), [])


def test_rows(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x " * 3000), (5, "a b c d e\n\n \na b c d e\nq\n a b c d e\nq"), (None, "é # $ <a> b c d e f g h i")]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(6, " ".join(f"w{i}" for i in range(2000)) + f" {passage} mid {passage}"), (7, " ".join(f"w{i}" for i in range(500)))]
    for i in range(100):
        rows.append((100 + i, "".join(rng.choice(["a ", "b ", "cc ", "\n", "#x ", "é　y ", "\x0b"]) for _ in range(rng.randint(0, 120)))))
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS kept")
    out = quality_rules.judge(df).collect()
    want = {i: brute(t) for i, t in rows}
    assert len(out) == len(rows) + 1 and all(tuple(r)[1:7] == want[r.doc_id] for r in out)
    kept = {r.doc_id: (r.kept, r.longest_repeat) for r in out}
    assert kept[6] == (False, 60) and kept[7] == (True, 0) and not any(r.kept for r in out if r.base_failed)
    assert quality_rules.judge(df.limit(0)).collect() == []
    spans = {tuple(r) for r in quality_rules.repeat_spans(df.where("doc_id = 6")).collect()}
    assert spans == {(6, 2000, 60), (6, 2061, 60)}
