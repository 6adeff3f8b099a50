"""Exact removal of repeated word windows, by super-k-mers.

The minimiser of a window is the least hash among its runs of eight words.
Consecutive windows of a text that share the minimiser at one place form a
super-k-mer and travel as one packed string; equal windows have equal minimisers,
so all copies of a window meet in one bucket, where sorting counts them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from .common import pieces, texts

WINDOW, RUN = 35, 8
# A bucket of more super-k-mers than this travels window by window, dealt over several tasks.
BUCKET = 512

_MULTIPLIERS = np.cumprod(np.full(RUN, 0x9E3779B97F4A7C15, np.uint64))


class _Hashes(dict):
    """XXH64 of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_kmers(
    hashes: np.ndarray, text_of: np.ndarray, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of every super-k-mer.

    ``hashes``: of the words of several texts one after the other; ``text_of``:
    each word's text.  Windows lie within one text.
    """
    empty = np.empty(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty
    n = len(hashes) - RUN + 1
    runs = np.zeros(n, np.uint64)
    for k in range(RUN):
        runs += hashes[k : k + n] * _MULTIPLIERS[k]
    runs = _mixed(runs)
    span = window - RUN + 1
    least = np.empty(n - span + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    for at in range(0, len(least), 1 << 16):
        least[at : at + (1 << 16)] = view[at : at + (1 << 16)].argmin(axis=1)
    place = least + np.arange(len(least))
    inside = np.flatnonzero(text_of[: len(least)] == text_of[window - 1 :])
    if not len(inside):
        return empty, empty, empty
    # A place belongs to one text, but neighbours in one place must be next to each other.
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(place[inside]) != 0) | (np.diff(inside) != 1))))
    counts = np.diff(np.concatenate((begins, [len(inside)])))
    first = inside[begins]
    return first, counts, runs[place[first]].view(np.int64)


def _minimisers(window: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in pieces(batches, "text"):
            split = [raw.split() for raw in texts(batch.column("text"))]
            sizes = np.array([len(w) for w in split])
            hashes = np.fromiter((known[w] for words in split for w in words), np.uint64, int(sizes.sum()))
            text_of = np.repeat(np.arange(len(split)), sizes)
            first, counts, keys = super_kmers(hashes, text_of, window)
            if len(first):
                row = text_of[first]
                starts = first - (np.cumsum(sizes) - sizes)[row]
                took = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        batch.column("ref").take(took),
                        pa.array(starts.astype(np.int32)),
                        pa.array(counts.astype(np.int32)),
                        batch.column("copies").take(took),
                    ],
                    ["key", "ref", "start", "n", "copies"],
                )

    return run


_PACKED = "key bigint, packed binary, single boolean, ref binary, start int, n int, copies bigint"


def _pack(window: int, bucket: int):
    """Super-k-mers as packed strings; those of large buckets as one digest per window."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            refs, copies = batch.column("ref").to_pylist(), batch.column("copies").to_pylist()
            spans = batch.column("spans").to_pylist()
            for raw, ref, times, found in zip(texts(batch.column("text")), refs, copies, spans):
                words = raw.split()
                salt = int.from_bytes(ref[:6], "big")
                for x in found:
                    start, n, key, rows = x["start"], x["n"], x["key"], x["rows"]
                    if rows <= bucket:
                        packed = b" ".join(words[start : start + n + window - 1])
                        out.append((key, packed, False, ref, start, n, times))
                        continue
                    parts = -(-rows // bucket)
                    for at in range(start, start + n):
                        digest = hashlib.blake2b(b" ".join(words[at : at + window]), digest_size=16).digest()
                        dealt = xxhash.xxh64_intdigest(digest, salt % parts)
                        out.append((dealt - (1 << 63), digest, True, ref, at, 1, times))
                if len(out) >= 20_000:
                    yield _packed_rows(out)
                    out = []
            if out:
                yield _packed_rows(out)

    return run


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
    columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key", "packed", "single", "ref", "start", "n", "copies"])


_COUNTED = "digest binary, total bigint, ref binary, start int, n int"


def _count(window: int):
    """Repeated windows of each bucket.

    A row with a digest is the total of one window in one of the parts of a
    large bucket, with the window's place if that was the only one there.
    """

    def runs(places: list[tuple[bytes, int]]) -> Iterator[tuple]:
        places.sort()
        at = 0
        while at < len(places):
            end = at + 1
            while end < len(places) and places[end] == (places[at][0], places[at][1] + end - at):
                end += 1
            yield (None, 2, places[at][0], places[at][1], end - at)
            at = end

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        windows = []
        for packed, single, ref, start, n, copies in rows:
            if single:
                windows.append((packed, True, ref, start, copies))
                continue
            lengths = [len(w) + 1 for w in packed.split(b" ")]
            begin, end = 0, sum(lengths[: window - 1]) - 1
            for j in range(n):
                end += lengths[j + window - 1]
                windows.append((packed[begin:end], False, ref, start + j, copies))
                begin += lengths[j]
        windows.sort(key=lambda x: x[:2])
        repeated, at = [], 0
        while at < len(windows):
            end, total = at, 0
            while end < len(windows) and windows[end][:2] == windows[at][:2]:
                total += windows[end][4]
                end += 1
            if total > 1:
                repeated += [x[2:4] for x in windows[at:end]]
            if windows[at][1]:
                alone = total == 1
                yield windows[at][0], total, windows[at][2] if alone else None, windows[at][3] if alone else None, 1
            at = end
        yield from runs(repeated)

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            names = ("key", "packed", "single", "ref", "start", "n", "copies")
            for k, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if k != key:
                    if len(rows) > 1 or rows and (rows[0][1] or rows[0][5] > 1):
                        out += solve(rows)
                    key, rows = k, []
                rows.append(tuple(row))
            if len(out) > 20_000:
                yield _counted_rows(out)
                out = []
        if rows:
            out += solve(rows)
        if out:
            yield _counted_rows(out)

    return run


def _counted_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
    columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["digest", "total", "ref", "start", "n"])


def _clean(window: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for raw, found in zip(texts(batch.column("text")), batch.column("places").to_pylist()):
                words = raw.split()
                covered = np.zeros(len(words) + 1, np.int64)
                for x in found or ():
                    covered[x["start"]] += 1
                    covered[x["start"] + x["n"] + window - 1] -= 1
                gone = np.cumsum(covered)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((len(words), int(gone.sum()), kept))
            n, gone, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ref"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["ref", "n_words", "n_removed", "kept"],
            )

    return run


def repeated_places(distinct: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """(ref, places) of distinct texts (ref, text, copies): where repeated windows begin, as runs."""
    kmers = distinct.mapInArrow(
        _minimisers(window), "key bigint, ref binary, start int, n int, copies bigint"
    )
    # Windows of one super-k-mer differ, so a repeat takes two of them with one minimiser.
    shared = (
        kmers.groupBy("key")
        .agg(F.sum("copies").alias("_all"), F.count("*").cast("int").alias("rows"))
        .where("_all > 1")
        # Another key than that of the groups: what many super-k-mers share is then dealt anew and can be cut.
        .select((F.col("key") + 1).alias("_next"), "rows")
    )
    near = kmers.select((F.col("key") + 1).alias("_next"), "ref", "start", "n").join(shared, "_next")
    spans = near.groupBy("ref").agg(
        F.collect_list(F.struct("start", "n", F.col("_next").alias("key"), "rows")).alias("spans")
    )
    packed = distinct.join(spans, "ref").select("ref", "text", "copies", "spans").mapInArrow(
        _pack(window, bucket), _PACKED
    )
    counted = packed.repartition("key").sortWithinPartitions("key").mapInArrow(_count(window), _COUNTED)
    # Parts of a large bucket are added up; all other rows are groups of their own.
    group = F.coalesce(F.hex("digest"), F.concat(F.hex("ref"), F.lit("/"), F.col("start").cast("string")))
    total = F.sum("total").over(Window.partitionBy("_group"))
    found = counted.withColumn("_group", group).withColumn("_total", total)
    return (
        found.where("_total > 1 AND ref IS NOT NULL")
        .groupBy("ref")
        .agg(F.collect_list(F.struct("start", "n")).alias("places"))
    )


def dedup_texts(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """(ref, n_words, n_removed, kept) per distinct text; ref is its MD5, kept the words that stay."""
    # Never null, and known to be: else a join would filter the texts once more, below their exchange,
    # and could not share it with the other uses.
    ref = F.coalesce(F.unhex(F.md5(F.col("text").cast("string").cast("binary"))), F.lit(b""))
    plain = docs.select(F.col("text").cast("string").alias("text")).withColumn("ref", ref)
    # Equal texts are one; every use below reads this one exchange.
    distinct = (
        plain.where("text IS NOT NULL")
        .groupBy("ref")
        .agg(F.max("text").alias("text"), F.count("*").alias("copies"))
    )
    places = repeated_places(distinct, window, bucket)
    joined = distinct.join(places, "ref", "left").select("ref", "text", "copies", "places")
    return joined.mapInArrow(_clean(window), "ref binary, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs`` (doc_id, text).

    Words are runs other than ASCII white space.  A word goes if it lies in a
    window of ``window`` words whose sequence starts at another place too, in
    the same document or another; windows are judged on the texts as given.
    Null and empty texts have no words; equal texts, and so repeated rows, are
    worked on once and count as often as they occur; a null doc_id stays null;
    an empty table gives no rows.  :func:`dedup_texts` has the texts that stay.

    What a bucket holds is bounded: one with more than ``bucket`` super-k-mers
    sends a 128-bit digest for each window instead, dealt over as many tasks as
    its size asks for, and the parts' totals are added up.
    """
    cleaned = dedup_texts(docs, window, bucket).select(
        F.hex("ref").alias("_ref"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
    ref = F.upper(F.md5(F.col("text").cast("string").cast("binary")))
    rows = docs.select("doc_id", ref.alias("_ref"))
    both = lookup_join(rows, cleaned, "_ref", "left", spread="doc_id")
    return both.select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)).alias("kept_sha256"),
    )
