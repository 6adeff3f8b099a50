"""Fill-in-the-middle examples out of seekable compressed texts.

A text is stored as independent zstandard frames of whole units (a run of
blanks with the word after it, or blanks at the end), each with the units and
characters up to its end.  A cut after some unit decompresses only the frame it
falls into; all other frames go into the example as they are, so an example is
again a row of frames, whose concatenation any zstandard reader decompresses to
the text.  Digests run over the frames one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

# Bytes of text in a frame; a single unit that is longer is a frame of its own.
FRAME_BYTES, LEVEL = 64 << 10, 3
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))
_FRAMES_SQL = "array<struct<units: bigint, chars: bigint, data: binary>>"


def unit_ends(data: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Where units end (exclusive) in bytes of UTF-8; ``last``: the last byte of each text, ascending."""
    if not len(data):
        return np.empty(0, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.empty(len(data), bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    ends[-1] = True
    if last is not None:
        ends[last] = True
    return np.flatnonzero(ends) + 1


def _chars(data: np.ndarray) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _cuts(ends: np.ndarray, frame_bytes: int) -> list[int]:
    """Numbers of units at which frames end: as many as fit, one at least."""
    cuts, start = [], 0
    while not cuts or cuts[-1] < len(ends):
        done = cuts[-1] if cuts else 0
        cuts.append(max(done + 1, int(np.searchsorted(ends, start + frame_bytes, "right"))))
        start = int(ends[cuts[-1] - 1])
    return cuts


def _frame(frame_bytes: int, level: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in pieces(batches, "text"):
            raw = texts(batch.column("text"))
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            data = np.frombuffer(b"".join(raw), np.uint8)
            ends = unit_ends(data, bounds[1:][sizes > 0] - 1)
            places = np.searchsorted(ends, bounds, "right")
            offsets, units, chars, frames = [0], [], [], []
            for i, text in enumerate(raw):
                if text:
                    own = ends[places[i] : places[i + 1]] - bounds[i]
                    start = seen = 0
                    for cut in _cuts(own, frame_bytes):
                        end = int(own[cut - 1])
                        seen += _chars(data[bounds[i] + start : bounds[i] + end])
                        units.append(cut)
                        chars.append(seen)
                        frames.append(press.compress(text[start:end]))
                        start = end
                offsets.append(len(frames))
            flat = pa.StructArray.from_arrays(
                [pa.array(units, pa.int64()), pa.array(chars, pa.int64()), pa.array(frames, pa.binary())],
                names=["units", "chars", "data"],
            )
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "frames"])

    return run


def frame_texts(docs: DataFrame, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """(doc_id, frames): every text as frames of about ``frame_bytes``, with units and characters up to each end.

    ``docs``: doc_id, text; other columns are not read.  A row for each row,
    repeated ones too; an empty or null text has no frames; an empty table gives
    no rows.  A long text is cut while it is framed, and later steps hold one of
    its frames at a time.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_frame(frame_bytes, level), f"doc_id bigint, frames {_FRAMES_SQL}")


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers that depend on nothing but the seed and the id (a null id is an empty one)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def split_at(frames: Sequence[dict], units: int, open_frame) -> tuple[int, bytes, int]:
    """Where ``units`` end: frames before, bytes of the next one before the cut, characters before the cut."""
    lo, hi = 0, len(frames)
    while lo < hi:  # the first frame that ends after the cut
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if frames[mid]["units"] <= units else (lo, mid)
    before, chars = (frames[lo - 1]["units"], frames[lo - 1]["chars"]) if lo else (0, 0)
    if units == before:
        return lo, b"", chars
    text = open_frame(lo)
    data = np.frombuffer(text, np.uint8)
    end = int(unit_ends(data)[units - before - 1])
    return lo, text[:end], chars + _chars(data[:end])


class _Writer:
    """Joins loose bytes into frames; whole frames pass as they are."""

    def __init__(self, press: zstandard.ZstdCompressor, frame_bytes: int) -> None:
        self.press, self.frame_bytes, self.frames, self.loose = press, frame_bytes, [], b""

    def text(self, data: bytes) -> None:
        if self.loose and len(self.loose) + len(data) > self.frame_bytes:
            self.flush()
        self.loose += data

    def frame(self, data: bytes) -> None:
        self.flush()
        self.frames.append(data)

    def flush(self) -> None:
        if self.loose:
            self.frames.append(self.press.compress(self.loose))
            self.loose = b""


def _example(frames: list[dict], draw: list[int], fim: int, spm: int, press, unpress, frame_bytes: int) -> tuple:
    """(units, form, prefix characters, middle characters, frames of the example) of one text."""
    n = frames[-1]["units"] if frames else 0
    plain = (n, "plain", None, None, [f["data"] for f in frames])
    if not frames or draw[2] % 100 >= fim:
        return plain
    held: dict[int, bytes] = {}

    def open_frame(i: int) -> bytes:
        if i not in held:
            held.clear()
            held[i] = unpress.decompress(frames[i]["data"])
        return held[i]

    # No mark holds a blank, so none lies across the ends of frames.
    if any(mark in open_frame(i) for i in range(len(frames)) for mark in ORDER["psm"]):
        return plain
    first, second = sorted(d % (n + 1) for d in draw[:2])
    a, head, prefix_chars = split_at(frames, first, open_frame)
    b, upto, both_chars = split_at(frames, second, open_frame)
    tail = open_frame(b)[len(upto) :] if upto else b""
    rest = open_frame(a)[len(head) :] if head else b""
    whole = lambda i, j: [f["data"] for f in frames[i:j]]
    parts = {
        PREFIX: [*whole(0, a), (head,)],
        SUFFIX: [(tail,), *whole(b + bool(upto), len(frames))],
        # Both cuts in one frame, or the rest of one, whole ones, and the start of another.
        MIDDLE: [(upto[len(head) :],)] if a == b else [(rest,), *whole(a + bool(head), b), (upto,)],
    }
    form = "spm" if draw[3] % 100 < spm else "psm"
    out = _Writer(press, frame_bytes)
    for mark in ORDER[form]:
        out.text(mark)
        for part in parts[mark]:
            out.text(part[0]) if isinstance(part, tuple) else out.frame(part)
    out.flush()
    return n, form, prefix_chars, both_chars - prefix_chars, out.frames


def _transform(seed: int, fim: int, spm: int, frame_bytes: int, level: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()
        for batch in batches:
            # Rows one by one: only one text's frames are Python objects at a time.
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = some.column("doc_id").to_pylist()
                done = [
                    _example(frames.as_py(), draws(i, seed), fim, spm, press, unpress, frame_bytes)
                    for i, frames in zip(ids, some.column("frames"))
                ]
                n, form, prefix, middle, out = zip(*done)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
                columns = [pa.array(c, t) for c, t in zip((n, form, prefix, middle, out), types)]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    return run


def fill_middle(
    framed: DataFrame,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    frame_bytes: int = FRAME_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the example made of each row of :func:`frame_texts`.

    ``output`` holds zstandard frames whose concatenation is the example.
    ``fim_percent`` of the ids are cut, ``spm_percent`` of these put the suffix
    first.  A text without units or with one of the marks stays plain, and both
    character counts are null.  Draws depend on seed and id alone, so repeated rows give
    equal examples; rows without an id draw by the empty id.
    """
    run = _transform(seed, fim_percent, spm_percent, frame_bytes, level)
    kinds = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>"
    return framed.select("doc_id", "frames").mapInArrow(run, kinds)


def _parts(chunks: Iterable[bytes], form: str) -> Iterator[tuple[bytes, bytes]]:
    """(mark, bytes after it) in the order of the example, found in its text alone."""
    marks = list(ORDER[form])
    at, rest = None, b""
    for chunk in chunks:
        rest += chunk
        while marks and (place := rest.find(marks[0])) >= 0:
            if at:
                yield at, rest[:place]
            at, rest = marks[0], rest[place + len(marks[0]) :]
            marks.pop(0)
        # A mark may begin at the end of a chunk.
        keep = 0 if not marks else min(len(rest), len(marks[0]) - 1)
        if at and len(rest) > keep:
            yield at, rest[: len(rest) - keep]
            rest = rest[len(rest) - keep :]
    if at and rest:
        yield at, rest


def restored(frames: Sequence[bytes], form: str, unpress: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text an example was made of, from its frames and form: prefix and middle, then the suffix in a second pass."""
    read = lambda: (unpress.decompress(f) for f in frames)
    if form == "plain":
        yield from read()
        return
    yield from (data for mark, data in _parts(read(), form) if mark != SUFFIX)
    yield from (data for mark, data in _parts(read(), form) if mark == SUFFIX)


def _digest(chunks: Iterable[bytes]) -> str:
    sha = hashlib.sha256()
    for chunk in chunks:
        sha.update(chunk)
    return sha.hexdigest()


def _read(batches) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        kept = batch.drop_columns(["output"])
        out, back = [], []
        for frames, form in zip(batch.column("output"), batch.column("form").to_pylist()):
            frames = frames.as_py()
            out.append(_digest(unpress.decompress(f) for f in frames))
            back.append(_digest(restored(frames, form, unpress)))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(out, pa.string()), pa.array(back, pa.string())],
            [*kept.schema.names, "output_sha256", "restored_sha256"],
        )


def fill_middle_digest(examples: DataFrame) -> DataFrame:
    """The examples' counts with digests of the example and of the text rebuilt from it."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in examples.drop("output").dtypes)
    return examples.mapInArrow(_read, f"{kinds}, output_sha256 string, restored_sha256 string")


def _joined(batches) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = zip(batch.column("doc_id"), batch.column("form"), batch.column("output"))
        for doc_id, form, frames in rows:
            text = b"".join(unpress.decompress(f) for f in frames.as_py())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array([doc_id.as_py()], pa.int64()), "form": pa.array([form.as_py()], pa.string()), "text": pa.array([text.decode()], pa.string())}
            )


def fill_middle_texts(examples: DataFrame) -> DataFrame:
    """(doc_id, form, text): the examples as plain texts, one row in memory at a time."""
    return examples.select("doc_id", "form", "output").mapInArrow(_joined, "doc_id bigint, form string, text string")
