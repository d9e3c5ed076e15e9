"""Fill-in-middle transformation over seekable compressed frames.

``store`` turns each text into independent zstandard frames of ``FRAME_BYTES`` bytes (cut at a code point) and records
with each frame the units and code points up to its end. A unit is a run of ASCII letters or any other single character. A cut
after u units is then found in the cumulative counts, and only the frame in which that unit starts is decompressed to
place it. ``plan`` chooses form and cuts of each document from the counts alone, by columns. ``transform`` streams the
ordered frames of the three parts into the output, which is a sequence of frames again, so one frame of a text is open at
a time on the way in and one on the way out. ``restore`` finds the control strings in the stream of the output, and
streams the parts back in their first order. ``texts`` and ``digests`` read any sequence of frames.

A document without an id hashes as one whose id is empty. A null text is an empty one: no units, form plain. A text that holds a
control string is plain, so the first control string after the leading one is always that of the output. Texts may be of any length up to what a row of Spark holds;
a unit may be longer than a frame. Rows are mapped one to one, so repeated rows stay and there are no ties. Columns
other than the two named ones are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

FRAME_BYTES, LEVEL = 1 << 16, 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAMES = "array<struct<units: bigint, chars: bigint, data: binary>>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])


def unit_starts(data: np.ndarray, joined: bool = False) -> np.ndarray:
    """Which bytes of a UTF-8 text begin a unit; ``joined``: the text goes on after a letter."""
    letter = _LETTER[data]
    before = np.empty_like(letter)
    before[1:], before[:1] = letter[:-1], joined
    return _heads(data) & ~(letter & before)


def _heads(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


def frame_ends(raw: memoryview | bytes, size: int) -> list[int]:
    """Where frames of about ``size`` bytes end; no code point is cut."""
    ends, at = [], 0
    while at < len(raw):
        at = min(len(raw), at + size)
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        ends.append(at)
    return ends


class Writer:
    """Collects bytes into compressed frames; a frame holds whole code points."""

    def __init__(self, pack: zstandard.ZstdCompressor, size: int):
        self.pack, self.size, self.rest, self.frames, self.units, self.chars, self.joined = pack, size, bytearray(), [], 0, 0, False

    def add(self, piece: bytes) -> None:
        self.rest += piece
        if len(self.rest) >= 2 * self.size:
            self._flush(self.size)

    def _flush(self, least: int) -> None:
        done = 0
        for end in frame_ends(self.rest, self.size):
            if len(self.rest) - done < least:
                break
            data = np.frombuffer(self.rest, np.uint8, end - done, done)
            self.units += int(np.count_nonzero(unit_starts(data, self.joined)))
            self.chars += int(np.count_nonzero(_heads(data)))
            self.joined = bool(_LETTER[data[-1]])
            self.frames.append({"units": self.units, "chars": self.chars, "data": self.pack.compress(data.tobytes())})
            del data
            done = end
        del self.rest[:done]

    def close(self) -> list[dict]:
        self._flush(0)
        return self.frames


class Reader:
    """A stored text: cumulative counts of its frames, and frames that are opened when they are asked for."""

    def __init__(self, frames: list[dict] | None, unpack: zstandard.ZstdDecompressor):
        self.frames, self.unpack = frames or [], unpack
        self.units = [f["units"] for f in self.frames]

    def open(self, k: int) -> bytes:
        return self.unpack.decompress(self.frames[k]["data"])

    def seek(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points of the whole text before it) where this unit starts; past the last: the end."""
        k = bisect_right(self.units, unit)
        if k == len(self.frames):
            return k, 0, self.frames[-1]["chars"] if self.frames else 0
        data = np.frombuffer(self.open(k), np.uint8)
        before, chars = (self.units[k - 1], self.frames[k - 1]["chars"]) if k else (0, 0)
        own = np.flatnonzero(unit_starts(data))
        own = own[len(own) - (self.units[k] - before) :]  # without a start that is a letter's after the frame before
        byte = int(own[unit - before])
        return k, byte, chars + int(np.count_nonzero(_heads(data[:byte])))

    def stream(self, start: tuple[int, int] = (0, 0), end: tuple[int, int] | None = None) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, each a frame and a byte in it, one frame at a time."""
        last, stop = end or (len(self.frames), 0)
        for k in range(start[0], min(last + (stop > 0), len(self.frames))):
            yield self.open(k)[start[1] if k == start[0] else 0 : stop if k == last else None]


def marked(texts: pa.Array) -> np.ndarray:
    """Which texts hold a control string."""
    import pyarrow.compute as pc

    return np.logical_or.reduce([pc.match_substring(texts, m.decode()).to_numpy(zero_copy_only=False) for m in (PREFIX, SUFFIX, MIDDLE)])


def _storing(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts = shared.strings(batch.column(1))
            for first, data, offsets in shared.slices(texts):
                n, rows = len(offsets) - 1, []
                starts, heads = unit_starts(data), _heads(data)
                begin = offsets[:-1][np.diff(offsets) > 0]
                starts[begin] = True  # the text before may end with a letter
                units, chars = np.concatenate([[0], np.cumsum(starts)]), np.concatenate([[0], np.cumsum(heads)])
                raw = data.tobytes()
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ends = [hi] if lo < hi <= lo + size else [lo + e for e in frame_ends(memoryview(raw)[lo:hi], size)]
                    rows.append([{"units": int(units[e] - units[lo]), "chars": int(chars[e] - chars[lo]), "data": pack.compress(raw[b:e])} for b, e in zip([lo, *ends], ends, strict=False)])
                total = lambda c: pa.array(c[offsets[1:]] - c[offsets[:-1]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), total(units), total(chars), pa.array(marked(texts.slice(first, n))), pa.array(rows, pa.list_(_FRAME))], ["doc_id", "n", "n_chars", "marked", "frames"])

    return run


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document: doc_id, n (units), n_chars, marked (holds a control string), frames."""
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_storing(frame_bytes), f"doc_id long, n long, n_chars long, marked boolean, frames {FRAMES}")


def _number(key: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 1."""
    return F.conv(F.substring(key, 8 * k - 7, 8), 16, 10).cast("long")


def plan(stored: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``stored`` with form (plain, psm or spm) and the cuts: units before the middle and before the suffix.
    ``percent`` of the documents are cut, ``spm_percent`` of these with the suffix first."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    a, b = _number(h, 1) % (F.col("n") + 1), _number(h, 2) % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (_number(h, 3) % 100 >= percent)
    form = F.when(plain, "plain").when(_number(h, 4) % 100 < spm_percent, "spm").otherwise("psm")
    return stored.withColumns({"form": form, "middle_at": F.least(a, b), "suffix_at": F.greatest(a, b)})


def parts_of(form: str, reader: Reader, middle: tuple, suffix: tuple) -> Iterator[bytes]:
    """The output's bytes in order."""
    if form == "plain":
        yield from reader.stream()
        return
    first = lambda: reader.stream((0, 0), middle[:2])
    last = lambda: reader.stream(suffix[:2])
    order = [(PREFIX, first), (SUFFIX, last)] if form == "psm" else [(SUFFIX, last), (PREFIX, first)]
    for mark, part in [*order, (MIDDLE, lambda: reader.stream(middle[:2], suffix[:2]))]:
        yield mark
        yield from part()


def _transforming(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in _small(batches):
            out = []
            for form, a, b, frames in zip(*(batch.column(c).to_pylist() for c in ("form", "middle_at", "suffix_at", "frames")), strict=True):
                reader, writer = Reader(frames, unpack), Writer(pack, size)
                middle = suffix = (0, 0, 0)
                if form != "plain":
                    middle, suffix = reader.seek(a), reader.seek(b)
                for piece in parts_of(form, reader, middle, suffix):
                    writer.add(piece)
                chars = (None, None) if form == "plain" else (middle[2], suffix[2] - middle[2])
                out.append((*chars, writer.close()))
            prefix, inner, made = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("form"), pa.array(prefix, pa.int64()), pa.array(inner, pa.int64()), pa.array(made, pa.list_(_FRAME))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    return run


def _small(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most about ``most`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def transform(planned: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars (null if plain), and the output's frames."""
    return planned.select("doc_id", "n", "form", "middle_at", "suffix_at", "frames").mapInArrow(_transforming(frame_bytes), f"doc_id long, n long, form string, prefix_chars long, middle_chars long, frames {FRAMES}")


def find(reader: Reader, marks: list[bytes]) -> list[tuple[int, int]]:
    """(frame, byte) of the first occurrence of each mark after that of the one before; a mark may lie across frames."""
    found, tail, at = [], b"", 0
    for k in range(len(reader.frames)):
        piece, tail_size = tail + reader.open(k), len(tail)
        at = max(0, at)
        while len(found) < len(marks) and (here := piece.find(marks[len(found)], at)) >= 0:
            found.append((k, here - tail_size))  # a negative byte lies in the frame before
            at = here + len(marks[0])
        tail = piece[-2:]
        at = at - (len(piece) - len(tail))
    return found


def restored_parts(form: str, reader: Reader) -> Iterator[bytes]:
    """The first text's bytes in order, read from the output and its form alone."""
    if form == "plain":
        yield from reader.stream()
        return
    marks = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    spots = [_moved(reader, spot, 0) for spot in find(reader, marks)]
    opens = [_moved(reader, spot, 3) for spot in spots]
    first, second, third = [reader.stream(a, b) for a, b in zip(opens, [*spots[1:], None], strict=True)]
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    yield from prefix
    yield from third
    yield from suffix


def _moved(reader: Reader, spot: tuple[int, int], by: int) -> tuple[int, int]:
    """The place ``by`` bytes further, in terms of the frame that holds it."""
    k, byte = spot[0], spot[1] + by
    while byte < 0:
        k -= 1
        byte += len(reader.open(k))
    while k < len(reader.frames) and byte >= (size := len(reader.open(k))):
        k, byte = k + 1, byte - size
    return k, byte


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in _small(batches):
        output, restored = [], []
        for form, frames in zip(batch.column("form").to_pylist(), batch.column("frames").to_pylist(), strict=True):
            reader = Reader(frames, unpack)
            for stream, out in ((reader.stream(), output), (restored_parts(form, reader), restored)):
                digest = hashlib.sha256()
                for piece in stream:
                    digest.update(piece)
                out.append(digest.hexdigest())
        kept = [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(output, pa.string()), pa.array(restored, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])


def digests(transformed: DataFrame) -> DataFrame:
    """The digests of the output and of the text that is rebuilt from it, beside the columns of ``transform``."""
    return transformed.mapInArrow(_digesting, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def texts(transformed: DataFrame, restore: bool = False) -> DataFrame:
    """doc_id, form, and the output as text (``restore``: the text rebuilt from it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _small(batches):
            readers = [(form, Reader(frames, unpack)) for form, frames in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            made = [b"".join(restored_parts(form, r) if restore else r.stream()).decode() for form, r in readers]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["doc_id", "form", "text"])

    return transformed.select("doc_id", "form", "frames").mapInArrow(run, "doc_id long, form string, text string")
