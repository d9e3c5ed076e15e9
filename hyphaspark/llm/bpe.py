"""BPE encoding and decoding with a pair occurrence index.

``encode`` turns each text into token ids exactly as the vocabulary file's own library would (special
strings in the text become their tokens; nothing is added, cut or padded). A task gathers the distinct
words of a batch, lays their symbols out in one array and indexes every adjacent pair that has a merge
rank by its positions. Active ranks are taken in ascending order; a rank is applied to all its
positions at once, and only the neighbouring pairs are entered again. Words keep their ids for the
rest of the task. Nothing is shuffled and no model is trained.

``decode`` turns ids into text as the library's decode with special tokens kept: such a vocabulary
has no decoder, so the tokens are joined by blanks.

A null or empty text has no tokens and decodes to the empty string; null ids decode like empty ones.
Rows are mapped one to one (repeated rows and null doc ids stay); columns other than the two named
ones are not read. An empty table gives an empty result. There are no ties: equal texts have equal ids. A text is never cut; a very
long one needs about 40 bytes of memory a byte of it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 250_000
WORD_BATCH = 1 << 16


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next
    free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Tables of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.strings = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")")
        chars = _byte_chars()
        self.inner = np.array([ids[c] for c in chars], np.int64)
        self.last = np.array([ids[c + self.end] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pairs.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.left, self.right, self.made = (np.zeros(len(merges), np.int64) for _ in range(3))
        for key, (rank, made) in pairs.items():
            self.left[rank], self.right[rank], self.made[rank] = key >> 20, key & 0xFFFFF, made
        first_use = {}
        for rank in range(len(merges)):
            for t in (self.left[rank], self.right[rank]):
                first_use.setdefault(int(t), rank)
        #: A merge that an earlier rank can use must be applied one position a word at a time.
        self.single = {r for r in range(len(merges)) if first_use.get(int(self.made[r]), len(merges)) <= r}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no final sigma


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words one after another, and the len + 1 offsets."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), np.uint8)
    sym = v.inner[data]
    sym[ends - 1] = v.last[data[ends - 1]]
    total = len(sym)
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    after[ends - 1] = -1
    before[ends - sizes] = -1
    word = np.repeat(np.arange(len(words)), sizes)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[after[at] >= 0]
        ranks = v.rank(sym[at], sym[after[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if len(at) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for part, r in zip(np.split(at, cuts), ranks[np.concatenate([[0], cuts])].tolist(), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(part)

    enter(np.arange(total))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        a, b = v.left[r], v.right[r]
        follow = after[at]
        at = at[(sym[at] == a) & (follow >= 0) & (sym[follow] == b)]
        if a == b and len(at) > 1:  # in a run of equal symbols, every other one from the left
            joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
            start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if len(at) and r in v.single:
            _, first = np.unique(word[at], return_index=True)
            rest = np.delete(at, first)
            at = at[first]
        else:
            rest = at[:0]
        if len(at) == 0:
            continue
        gone = after[at]
        follow = after[gone]
        sym[at], sym[gone], after[at] = v.made[r], -1, follow
        has = follow >= 0
        before[follow[has]] = at[has]
        left = before[at]
        enter(np.unique(np.concatenate([left[left >= 0], at, rest])))
    alive = sym >= 0
    counts = np.bincount(word[alive], minlength=len(words))
    return sym[alive].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        number: dict[str, int] = {}
        tokens, offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

        def settle(docs: list[np.ndarray], fresh: list[str]) -> pa.Array:
            nonlocal tokens, offsets
            parts, cuts = [tokens], [offsets]
            for lo in range(0, len(fresh), WORD_BATCH):
                some = fresh[lo : lo + WORD_BATCH]
                plain = [w for w in some if w not in v.special]
                made, at = merge_words(plain, v) if plain else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
                if len(plain) < len(some):  # special strings are single tokens
                    made_at, out, sizes = 0, [], []
                    for w in some:
                        piece = np.array([v.special[w]], np.uint32) if w in v.special else made[at[made_at] : at[made_at + 1]]
                        made_at += w not in v.special
                        out.append(piece)
                        sizes.append(len(piece))
                    made, at = np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])
                parts.append(made)
                cuts.append(at[1:] + cuts[-1][-1])
            tokens, offsets = np.concatenate(parts), np.concatenate(cuts)
            flat = np.concatenate([np.zeros(0, np.int64), *docs])
            sizes = offsets[flat + 1] - offsets[flat]
            total = np.concatenate([[0], np.cumsum(sizes)])
            ids = tokens[np.repeat(offsets[flat] - total[:-1], sizes) + np.arange(total[-1])]
            bounds = 4 * total[np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)]
            return pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())

        for batch in batches:
            docs, fresh, size, first = [], [], 0, 0
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py() or ""
                found: list[int] = []
                for k, piece in enumerate(v.specials.split(text)):
                    for w in [piece] if k % 2 else v.words.findall(v.normal(piece)):
                        n = number.get(w)
                        if n is None:
                            n = number[w] = len(number)
                            fresh.append(w)
                        found.append(n)
                docs.append(np.array(found, np.int64))
                size += len(found)
                if size > 500_000 or row == batch.num_rows - 1:
                    ids = settle(docs, fresh)
                    n_tokens = pa.array(np.diff(np.frombuffer(ids.buffers()[1], np.int32)[: len(docs) + 1]).astype(np.int64) // 4)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(docs)).cast(pa.int64()), n_tokens, ids], ["doc_id", "n_tokens", "ids"])
                    docs, fresh, size, first = [], [], 0, row + 1
                    if len(number) > MAX_WORDS:
                        number.clear()
                        tokens, offsets = tokens[:0], offsets[:1]

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(path).strings
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [" ".join(map(strings.__getitem__, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid and len(x.as_buffer()) else "" for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "decoded"])

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_encoder(path), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the decoded text."""
    kept = encoded.select(*keep, ids_col)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_decoder(path), f"{schema}, decoded string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    encoded = encode(df, path, id_col, text_col).withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = decode(encoded, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
