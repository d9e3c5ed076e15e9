"""Language identification: script ranges, word scores and a Viterbi pass with a switching penalty.

``train`` counts hashed character 3- and 4-grams (bytes inside words, lower-cased A-Z) of labelled
texts for each language, and which scripts its letters belong to. It reads about ``PER_LANGUAGE``
labelled documents of each language (a documented bound, drawn by a hash of the row); only the text
and the label are used. The model is a table of fixed size times the number of languages.

``identify`` scores every word of every text for each language whose scripts meet the word's, and
finds the labels that maximise the scores less a penalty for each change of language over the whole
text. Long texts take their steps in runs of ``RUN`` words side by side: every run is first followed from
each possible label before it, the runs are chained, and then each is labelled from its true start, so the
labels are those of one pass over the text. A document's language is the one with most letters under its
labels (ties: the first in order of name), its score is that language's share of the letters. Letters of words
whose scripts no learned language uses count for none.

A null text, or one without a letter, gets ``und`` with score 0. A very long text is scored in pieces of
1 MB cut between words and needs about 30 bytes a word for four languages. Rows are mapped one to one: repeated
rows and null ids stay, other columns are not read, an empty table gives an empty result. Training
on no labelled text gives a model that answers ``und`` throughout.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

PER_LANGUAGE, BITS, RUN, SWITCH, PIECE = 4000, 16, 256, 10.0, 1 << 20
MAX_LANGUAGES = 512  # a model has 0.5 MB a language; more labels raise an error
UND = "und"

# First code point and script; a range goes up to the next one.
_SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)


@lru_cache(1)
def _letters() -> np.ndarray:
    """The script's bit of each code point that is a letter, else 0."""
    names = sorted({s for _, s in _SCRIPTS})
    bits = np.zeros(sys.maxunicode + 1, np.uint32)
    for (lo, name), hi in zip(_SCRIPTS, [*(lo for lo, _ in _SCRIPTS[1:]), sys.maxunicode + 1], strict=True):
        bits[lo:hi] = 1 << names.index(name)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x32400)), bool, 0x32400)
    bits[: len(letter)][~letter] = 0
    bits[len(letter) :] = 0
    return bits


def _letter_bits(data: np.ndarray) -> np.ndarray:
    """For each byte the script bit of the letter that begins there."""
    table, size = _letters(), len(data)
    out = table[np.minimum(data, 127)] * (data < 128)
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        b = data[wide].astype(np.int64)
        n = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = b & np.choose(n - 2, [0x1F, 0x0F, 0x07])
        for k in (1, 2, 3):
            more = data[np.minimum(wide + k, size - 1)].astype(np.int64) & 0x3F
            code = np.where(n > k, code << 6 | more, code)
        out[wide] = table[np.minimum(code, sys.maxunicode)]
    return out


_CLASS = np.full(256, 32, np.uint8)  # what n-grams see: letters and bytes beyond ASCII
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 3- and 4-grams that begin one byte before each byte, and where that byte is one of a
    word. What follows the end of a word has no influence, so a word has the same grams wherever it stands."""
    seen = _CLASS[data].astype(np.uint32)
    padded = np.concatenate([[np.uint32(32)], seen, [np.uint32(32), np.uint32(32)]])
    three = padded[:-3] << 16 | padded[1:-2] << 8 | padded[2:-1]
    four = three << 8 | np.where(padded[2:-1] == 32, np.uint32(32), padded[3:])
    bucket = lambda x, m: (x * np.uint32(m)) >> np.uint32(32 - BITS)
    with np.errstate(over="ignore"):
        return bucket(three * np.uint32(0x85EBCA6B) ^ three >> 7, 2654435769), bucket(four ^ four >> 15, 2246822519), seen != 32


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, bucket, n): partial counts of a task; kind 0 and 1: n-grams, 2: letters of a script bit."""
    counts: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, data, offsets in shared.slices(batch.column(1), PIECE):
            three, four, inside = _grams(data, offsets)
            script = _letter_bits(data)
            for d in range(len(offsets) - 1):
                lo, hi = offsets[d], offsets[d + 1]
                into = counts.setdefault(langs[first + d], [np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), np.zeros(32, np.int64)])
                into[0] += np.bincount(three[lo:hi][inside[lo:hi]], minlength=1 << BITS)
                into[1] += np.bincount(four[lo:hi][inside[lo:hi]], minlength=1 << BITS)
                own = script[lo:hi]
                into[2] += np.bincount(np.log2(own[own > 0]).astype(np.int64), minlength=32)
    for lang, kinds in counts.items():
        for kind, n in enumerate(kinds):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(np.full(len(used), kind)), pa.array(used), pa.array(n[used])], ["lang", "kind", "bucket", "n"])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", draw_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> dict:
    """A model from labelled texts: about ``per_language`` of each language, drawn by a hash of ``draw_col``."""
    labelled = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(draw_col)).alias("draw")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {"langs": [], "scripts": np.zeros(0, np.uint32), "tables": np.zeros((2, 1 << BITS, 0), np.float32)}
    shares = df.sparkSession.createDataFrame(sizes, "lang string, share double")
    drawn = labelled.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")
    rows = drawn.mapInArrow(_bag, "lang string, kind long, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()), key=lambda s: s.encode())
    number = {s: i for i, s in enumerate(langs)}
    which = np.array([number[s] for s in rows["lang"].to_pylist()], np.int64)
    kind, bucket, n = (rows[c].to_numpy() for c in ("kind", "bucket", "n"))
    tables, scripts = np.zeros((2, 1 << BITS, len(langs)), np.float32), np.zeros((32, len(langs)))
    for k in (0, 1):
        at, table = kind == k, np.full((1 << BITS, len(langs)), 0.1)
        table[bucket[at], which[at]] += n[at]
        tables[k] = np.log(table / table.sum(0)) / 2
    tables -= tables.max(2, keepdims=True)  # only differences matter
    scripts[bucket[kind == 2], which[kind == 2]] = n[kind == 2]
    masks = ((scripts > 0.02 * scripts.sum(0)) * (1 << np.arange(32))[:, None]).sum(0).astype(np.uint32)
    return {"langs": langs, "scripts": masks, "tables": tables}


def _word_scores(data: np.ndarray, offsets: np.ndarray, model: dict):
    """Word offsets of the texts, scores (words x languages), and letters of each word: all, and those in
    words that some language can have."""
    starts, _, word_at = shared.spans(data, offsets)
    if len(starts) == 0:
        return word_at, np.zeros((0, len(model["langs"])), np.float32), np.zeros((2, 0), np.int32)
    three, four, inside = _grams(data, offsets)
    each = model["tables"][0][three]
    each += model["tables"][1][four]
    each[~inside] = 0
    scores = np.add.reduceat(each, starts, axis=0)
    script = _letter_bits(data)
    masks = np.bitwise_or.reduceat(script, starts)
    letters = np.add.reduceat(script > 0, starts, dtype=np.int32)
    fits = (masks[:, None] & model["scripts"]) > 0
    some = fits.any(1)
    scores[~fits & some[:, None]] -= 1000
    scores[letters == 0] = 0
    return word_at, scores, np.stack([letters, letters * some])


def _advance(value: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    return np.maximum(value, value.max(-1, keepdims=True) - penalty) + scores


def viterbi(scores: np.ndarray, text_at: np.ndarray, penalty: float, run: int = RUN) -> np.ndarray:
    """Best labels of the texts text_at[i]..text_at[i+1]: all runs of all texts take their steps together."""
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    if n == 0 or k == 0:
        return labels
    n_runs = -(-np.diff(text_at) // run)
    owner = np.repeat(np.arange(len(n_runs)), n_runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    first = text_at[:-1][owner] + nth * run
    size = np.minimum(text_at[1:][owner] - first, run)
    order = np.argsort(-size, kind="stable")  # long runs first: those of more than t words stand in front
    first, size, nth, owner = first[order], size[order], nth[order], owner[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin = np.cumsum(n_runs) - n_runs
    active = np.searchsorted(-size, -np.arange(size[0]), "left")
    before = np.zeros((len(first), k))  # values of the labels of the word before each run
    later = np.flatnonzero(nth > 0)
    if len(later):  # from each label before a run to each label at its end; then runs are chained
        through = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(len(first), 0)
        for t in range(int(size[0])):
            m = active[t]
            some = np.flatnonzero(nth[:m] > 0)
            through[some] = _advance(through[some], scores[first[some] + t][:, None, :].astype(float), penalty)
        heads = np.flatnonzero((nth == 0) & (n_runs[owner] > 1))
        value = scores[first[heads]].astype(float)
        for t in range(1, int(size[heads].max())):
            value = _advance(value, scores[first[heads] + t], penalty)  # runs that others follow are whole
        texts = owner[heads]
        for r in range(1, int(n_runs.max())):
            some = n_runs[texts] > r
            texts, value = texts[some], value[some]
            at = place[begin[texts] + r]
            before[at] = value
            value = (value[:, :, None] + through[at]).max(1)
    jumped, origin = np.zeros((n, k), bool), np.zeros(n, np.int16)
    value = before.copy()
    for t in range(int(size[0])):
        m = active[t]
        at = first[:m] + t
        top = value[:m].max(1)[:, None] - penalty
        jump = top > value[:m]
        if t == 0:
            jump &= (nth[:m] > 0)[:, None]
        jumped[at], origin[at] = jump, value[:m].argmax(1)
        value[:m] = np.where(jump, top, value[:m]) + scores[at]
    state = value.argmax(1)
    if len(later):  # the label before a run for each label at its end, back from the last run
        back = np.arange(k)[None].repeat(len(first), 0)
        for t in range(int(size[0]) - 1, -1, -1):
            at = first[: active[t], None] + t
            own = back[: active[t]]
            back[: active[t]] = np.where(jumped[at, own], origin[at], own)
        for r in range(int(n_runs.max()) - 1, 0, -1):
            at = place[begin[n_runs > r] + r]
            state[place[begin[n_runs > r] + r - 1]] = back[at, state[at]]
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        labels[at] = state[:m]
        state[:m] = np.where(jumped[at, state[:m]], origin[at], state[:m])
    return labels


def _labelled(column: pa.Array, model: dict):
    """(first row, word offsets, labels, letters) over groups of slices."""
    most = max(1 << 16, PIECE * 4 // max(4, len(model["langs"])))
    held, words = [], 0

    def settle():
        cuts, base = [np.zeros(1, np.int64)], 0
        for _, at, scores, _ in held:
            cuts.append(at[1:] + base)
            base += len(scores)
        labels = viterbi(np.concatenate([s for _, _, s, _ in held]), np.concatenate(cuts), SWITCH)
        base = 0
        for first, at, scores, letters in held:
            yield first, at, labels[base : base + len(scores)], letters
            base += len(scores)

    for first, data, offsets in shared.slices(column, most):
        parts, lo = [], 0
        while len(data) - lo > 2 * most:  # one long text: scored in pieces, cut between words
            gap = np.flatnonzero(shared._SPACE[data[lo + most : lo + 2 * most]])
            hi = lo + most + int(gap[0]) if len(gap) else lo + 2 * most + int(np.argmax(np.append(shared._SPACE[data[lo + 2 * most :]], True)))
            parts.append(_word_scores(data[lo:hi], np.array([0, hi - lo]), model))
            lo = hi
        if lo:
            parts.append(_word_scores(data[lo:], np.array([0, len(data) - lo]), model))
            scores = np.concatenate([p[1] for p in parts])
            held.append((first, np.array([0, len(scores)]), scores, np.concatenate([p[2] for p in parts], 1)))
        else:
            held.append((first, *_word_scores(data, offsets, model)))
        words += len(held[-1][2])
        if words > (1 << 21) // max(4, len(model["langs"])):
            yield from settle()
            held, words = [], 0
    if held:
        yield from settle()


def _verdicts(column: pa.Array, m: dict):
    """(first row, predicted language or und, score) over groups of texts."""
    k = len(m["langs"])
    names = np.array([*m["langs"], UND], object)
    for first, at, labels, letters in _labelled(column, m):
        n = len(at) - 1
        text = np.repeat(np.arange(n), np.diff(at))
        votes = np.bincount(text * max(1, k) + labels, weights=letters[1], minlength=n * max(1, k)).reshape(n, max(1, k))
        total = np.bincount(text, weights=letters[0], minlength=n)
        winner = np.where((total > 0) & (k > 0), votes.argmax(1), k)
        yield first, names[winner], np.where(winner < k, votes.max(1) / np.maximum(total, 1), 0.0)


def _identifier(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, langs, score in _verdicts(batch.column(1), model.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(langs)), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def _span_maker(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m["langs"], UND], object)
        for batch in batches:
            for first, at, labels, _ in _labelled(batch.column(1), m):
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                if len(text) == 0 or not m["langs"]:
                    continue
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (labels[1:] != labels[:-1])]))
                size = np.diff(np.append(new, len(text)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + text[new])), pa.array(new - at[text[new]]), pa.array(size), pa.array(names[labels[new]], pa.string())], ["doc_id", "first_word", "n_words", "lang"])

    return run


def _read(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    return _read(df, id_col, text_col).mapInArrow(_identifier(shipped), "doc_id long, lang_pred string, score double")


def keep(df: DataFrame, model: dict, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows of ``df``, all columns, whose text has a language with at least ``min_score`` of its letters."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def decide(column: pa.Array) -> np.ndarray:
        parts = [(langs != UND) & (score >= min_score) for _, langs, score in _verdicts(column, shipped.value)]
        return np.concatenate([np.zeros(0, bool), *parts])

    return shared.keep_rows(df, text_col, decide)


def label_spans(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of one language: doc_id, first_word (from 0), n_words, lang."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    return _read(df, id_col, text_col).mapInArrow(_span_maker(shipped), "doc_id long, first_word long, n_words long, lang string")


def held_out(id_col: str = "doc_id"):
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
