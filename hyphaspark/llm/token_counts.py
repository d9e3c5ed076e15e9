"""Token counts with overlap resynchronisation.

Texts of up to ``CHUNK`` characters go through the library whole. A longer one is encoded in overlapping chunks
with offsets, so the work of a step does not grow with the text. Two neighbouring chunks are spliced at a position that is a token boundary in both and
is proven stable: a blank that follows something else starts there, and no piece of the vocabulary
holds a blank after another character, so no merge can ever cross it, whatever stands further away.
(The vocabulary is tested for this when it is loaded; without the property texts are encoded whole.)
Where an overlap has no such position, it is widened, at last up to the end of the text.

A null or empty text has no bytes and no tokens. Rows are mapped one to one: repeated rows and null
ids stay, further columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 13, 1 << 9
BLANKS = " ▁"  # the library reads both as its blank


@lru_cache(4)
def model(path: str):
    """The processor, and whether a blank after another character is a stable boundary."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (p.id_to_piece(i) for i in range(p.vocab_size()))
    stable = not any("▁" in s.lstrip("▁") for s in pieces)
    probe = "a  b 　 ﬁ\n c"
    same = "".join(p.encode(probe, out_type=str)).replace("<0x0A>", "\n") == "▁" + probe.replace(" ", "▁")
    return p, stable and same


def _boundaries(p, text: str) -> np.ndarray:
    """Character positions where tokens begin, ascending, with repeats for tokens of one character."""
    begins = np.array([q.begin for q in p.encode(text, return_type="proto").pieces], np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))  # the character of each byte
    return chars[begins]


def _stable(text: str, at: int) -> bool:
    return at > 0 and text[at] in BLANKS and text[at - 1] not in BLANKS


def count_long(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, from overlapping chunks."""
    p, provable = model(path)
    if not provable or len(text) <= chunk + overlap:
        return len(p.encode(text))
    total, base, lo, extra = 0, 0, 0, overlap  # the current chunk begins at base and counts from lo on
    hi = chunk + extra
    left = _boundaries(p, text[:hi])
    while hi < len(text):
        start = hi - extra  # the next chunk begins here; the two share start..hi
        right_hi = min(len(text), start + chunk + extra)
        right = _boundaries(p, text[start:right_hi]) + start
        common = np.intersect1d(left[left > max(start, lo)], right)
        splice = next((int(c) for c in common if c < hi and _stable(text, int(c))), None)
        if splice is None:
            extra *= 2
            hi = min(len(text), hi + extra)
            left = _boundaries(p, text[base:hi]) + base
            left = left[left >= lo]
            continue
        total += int(np.count_nonzero(left < splice))
        base, lo, hi, extra = start, splice, right_hi, overlap
        left = right[right >= splice]
    return total + len(left)


def _counter(path: str, long: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, _ = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                short = [i for i, x in enumerate(texts) if len(x) <= long]
                n = np.zeros(len(texts), np.int64)
                n[short] = [len(ids) for ids in p.encode([texts[i] for i in short], num_threads=1)] if short else []
                for i, x in enumerate(texts):
                    if len(x) > long:
                        n[i] = count_long(x, path, long, OVERLAP)
                size = np.array([len(x.encode()) for x in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Texts of more
    than ``chunk`` characters are encoded in overlapping chunks."""
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_counter(path, chunk, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
