"""Quality rules with suffix-array repetition.

Texts are sequences of words. Documents in which some window of ``min_repeat`` words occurs twice get
a suffix array (prefix doubling over the words of many documents at once; a document's end differs
from everything else, so no repeat crosses documents). The longest common prefix of a suffix and the one
before it in the array is found where it is not implied: a suffix whose preceding word differs from its
neighbour's is compared word by word, many suffixes at once; every other one has one word less than the
suffix that starts a word earlier. The sum of what is compared is within n log n, and the memory is linear. Each
word position then knows the longest repeat that starts there, positions that an earlier one extends to the left
are dropped, and what is left are the occurrences of the maximal repeats. The rules limit the share of words
under the union of their spans and the length of the longest one, on top of the base rules (number of words,
share of words in repeated windows). Words and lines are compared by 64-bit hashes (see ``shared``).

A null or empty text has no words and fails. A text is never cut: a very long one is a slice of its own and
needs about 40 bytes of memory a byte of it if it repeats itself, 15 if not. Repeated rows and null ids are
mapped one to one, columns other than the two named ones are not read, and an empty table gives an empty result.
There are no ties: each count is that of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 10, 5, 20
MAX_COVERED, MAX_LONGEST = 0.15, 50

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NEWLINE = np.arange(256) == 10
_SPACE = shared._SPACE


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of the suffixes in their order, by prefix doubling. No suffix may be another one's prefix."""
    _, rank = np.unique(symbols, return_inverse=True)
    n, step = len(rank), 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1 or 2 * step >= n:
            return order
        step *= 2


def _agreement(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes a[i] and b[i] share at their start."""
    lcp, active, last = np.zeros(len(a), np.int64), np.arange(len(a)), len(symbols) - 1
    while len(active):
        width = max(4, min(1 << 14, (1 << 18) // len(active)))  # the fewer are left, the more symbols at once
        part = active[: (1 << 18) // width + 1]
        ahead = lcp[part][:, None] + np.arange(width)
        same = symbols[np.minimum(a[part][:, None] + ahead, last)] == symbols[np.minimum(b[part][:, None] + ahead, last)]
        n = np.where(same.all(1), width, same.argmin(1))
        lcp[part] += n
        active = np.concatenate([part[n == width], active[len(part) :]])
    return lcp


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of words that starts there and occurs again
    in the same text. ``text`` numbers the texts in ascending order."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.concatenate([[0], (text[1:] != text[:-1]).astype(np.int64)])
    place = np.arange(n) + np.cumsum(new)  # one stop after each text
    total = int(place[-1]) + 2
    _, symbols = np.unique(shared.mix(words ^ shared.mix(text.astype(np.uint64), 7)), return_inverse=True)
    stops = np.ones(total, bool)
    stops[place] = False
    line = np.empty(total, np.int64)
    line[place] = symbols + np.count_nonzero(stops)
    line[stops] = np.arange(np.count_nonzero(stops))
    order = suffix_array(line)
    before = np.empty(total, np.int64)  # the suffix before each one
    before[order[1:]], before[order[0]] = order[:-1], -1
    at = np.arange(total)
    implied = (at > 0) & (before > 0)
    implied[implied] = line[at[implied] - 1] == line[before[implied] - 1]
    own = np.flatnonzero(~implied)
    known = np.zeros(total, np.int64)
    some = own[before[own] >= 0]
    known[some] = _agreement(line, some, before[some])
    source = np.maximum.accumulate(np.where(implied, 0, at))
    lcp = known[source] - (at - source)
    best = lcp.copy()
    np.maximum.at(best, before[before >= 0], lcp[before >= 0])
    return best[place]


def _slice_stats(data: np.ndarray, offsets: np.ndarray, min_repeat: int):
    """Counts of each text of a slice, and the maximal repeats (text, first word, words)."""
    n = len(offsets) - 1
    starts, ends, word_at = shared.spans(data, offsets)
    words = shared.span_hashes(data, starts, ends)
    n_words = np.diff(word_at)
    text = np.repeat(np.arange(n), n_words)
    inside = ~_SPACE[data]
    out = {"n_words": n_words, "word_chars": shared.counts_within(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": shared.counts_within(_SYMBOL[data], offsets)}

    line_starts, line_ends, line_at = shared.spans(data, offsets, _NEWLINE)
    line_text = np.repeat(np.arange(n), np.diff(line_at))
    has = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_text = line_text[has]
    keys = shared.mix(shared.span_hashes(data, line_starts[has], line_ends[has]) ^ shared.mix(line_text.astype(np.uint64), 9))
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n)

    runs = shared.windows(words, min_repeat)
    whole = text[: len(runs)] == text[min_repeat - 1 :] if len(runs) else np.zeros(0, bool)
    keys = np.sort(shared.mix(runs[whole] ^ shared.mix(text[: len(runs)][whole].astype(np.uint64), 11)))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    suspects = np.zeros(n, bool)
    if len(twice):
        again = np.isin(shared.mix(runs ^ shared.mix(text[: len(runs)].astype(np.uint64), 11)), twice) & whole
        suspects[text[: len(runs)][again]] = True
    chosen = np.flatnonzero(suspects[text])
    best = longest_repeats(words[chosen], text[chosen])
    own = text[chosen]
    long = best >= min_repeat
    cover = np.zeros(len(chosen) + 1, np.int64)
    at = np.flatnonzero(long)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + best[at], -1)
    under = np.cumsum(cover[:-1]) > 0
    out["covered"] = np.bincount(own[under], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, own[at], best[at])
    out["longest_repeat"] = longest
    extended = np.concatenate([[False], (best[:-1] > best[1:]) & (own[:-1] == own[1:])]) if len(best) else np.zeros(0, bool)
    spots = np.flatnonzero(long & ~extended)
    first_word = chosen[spots] - word_at[own[spots]]
    return out, (own[spots], first_word, best[spots])


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "covered", "longest_repeat")


def _verdict(made: dict, max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (made["n_words"] < MIN_WORDS) | (100 * made["covered"] > MAX_REPEATED_PERCENT * made["n_words"])
    return failed, ~failed & (made["covered"] <= max_covered * made["n_words"]) & (made["longest_repeat"] <= max_longest)


def _stats(max_covered: float, max_longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in shared.slices(batch.column(1)):
                made, _ = _slice_stats(data, offsets, WINDOW)
                counts = [pa.array(made[c].astype(np.int64)) for c in _STATS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), *counts, *map(pa.array, _verdict(made, max_covered, max_longest))], ["doc_id", *_STATS, "base_failed", "kept"])

    return run


def _spans(min_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in shared.slices(batch.column(1)):
                _, (text, start, size) = _slice_stats(data, offsets, min_repeat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + first)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64))], ["doc_id", "first_word", "n_words"])

    return run


def repeat_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = WINDOW) -> DataFrame:
    """Every occurrence of a maximal repeat: doc_id, first_word (from 0), n_words."""
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_spans(min_repeat), "doc_id long, first_word long, n_words long")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and the repetition figures
    (repeats of fewer than five words count as none)."""
    made = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_stats(max_covered, max_longest), "doc_id long, " + ", ".join(f"{c} long" for c in _STATS) + ", base_failed boolean, kept boolean")
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("covered").alias("n_repeat_words"), "base_failed", "kept", "longest_repeat")


def keep(df: DataFrame, text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``df``, all columns, that ``judge`` would keep."""

    def decide(column: pa.Array) -> np.ndarray:
        parts = [_verdict(_slice_stats(data, offsets, WINDOW)[0], max_covered, max_longest)[1] for _, data, offsets in shared.slices(column)]
        return np.concatenate([np.zeros(0, bool), *parts])

    return shared.keep_rows(df, text_col, decide)
