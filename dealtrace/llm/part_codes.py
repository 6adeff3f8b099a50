"""Vectors as codes: each of their parts by the nearest entry of a small codebook.

Codebooks are refined by rounds of assignment and integer means.  Assignment
prunes with fixed pivots: the distance of every part to every pivot is computed
once and stored; in a round, those of the entries to the pivots give, by the
triangle inequality, a lower bound for each part and entry.  Entries are tried
in the order of their bounds, exactly and in integers, until a bound exceeds the
best distance found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from .common import keep

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
# Scaled components beyond this count as this, so that squared distances fit into 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Codebooks:
    """Stored rows (vec_id, label, v, far) and, per part, the pivots and the entries fitted to them."""

    rows: DataFrame
    pivots: np.ndarray  # parts x pivots x components
    entries: np.ndarray  # parts x entries x components


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the integers floor(scale * x) of rows that take part.

    Not taken are null vectors, those with null or non-finite components, empty ones, and
    those whose length is not the commonest (of equally common ones the smaller).
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(
        x, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c * scale).cast("bigint"))).cast("int")
    )
    kept = vectors.select("vec_id", "label", "embedding").where(~F.coalesce(bad, F.lit(True)) & (F.size("embedding") > 0))
    kept = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", whole.alias("v"))
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return kept.where(F.size("v") == (sizes[0].d if sizes else 0))


def in_parts(flat: np.ndarray, parts: int) -> np.ndarray:
    """Rows x parts x components; a length that ``parts`` does not divide is filled up with zeros."""
    n, d = flat.shape
    width = -(-d // parts)
    out = np.zeros((n, parts * width), np.int64)
    out[:, :d] = flat
    return out.reshape(n, parts, width)


def _rows(column: pa.Array, parts: int) -> np.ndarray:
    return in_parts(column.flatten().to_numpy().reshape(len(column), -1), parts)


def choose_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Of the first entries of one part, the first and then each time the one farthest from those chosen."""
    chosen = [0]
    nearest = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(entries)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of ``x`` by rows of ``to``."""
    return np.sqrt(np.stack([((x - t) ** 2).sum(axis=1) for t in to], axis=1).astype(np.float64))


def assign(x: np.ndarray, far: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance) of each row of one part, and the exact evaluations it took.

    ``far``: the rows' stored distances to the pivots.  Ties go to the lower entry.
    """
    n = len(x)
    near = _distances(entries, pivots)
    bounds = np.zeros((n, len(entries)))
    for i in range(len(pivots)):
        np.maximum(bounds, np.abs(far[:, i, None] - near[None, :, i]), out=bounds)
    # Bounds are differences of rounded roots; what they may be too high by.
    bounds -= 1e-12 * (far.max(initial=0.0) + near.max(initial=0.0)) + 1e-9
    order = np.argsort(bounds, axis=1, kind="stable")
    best, code = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    live, tried = np.arange(n), 0
    for rank in range(len(entries)):
        entry = order[live, rank]
        ahead = bounds[live, entry] <= np.sqrt(best[live].astype(np.float64))
        live, entry = live[ahead], entry[ahead]
        if not len(live):
            break
        tried += len(live)
        exact = ((x[live] - entries[entry]) ** 2).sum(axis=1)
        better = (exact < best[live]) | ((exact == best[live]) & (entry < code[live]))
        best[live[better]], code[live[better]] = exact[better], entry[better]
    return code, best, tried


def _measure(pivots: np.ndarray):
    """Add to each row the distances of its parts to the pivots, once."""
    parts = len(pivots)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("v"), parts)
                far = np.stack([_distances(x[:, p], pivots[p]) for p in range(parts)], axis=1)
                flat = far.reshape(batch.num_rows, -1)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * flat.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1)))],
                    [*batch.schema.names, "far"],
                )

    return run


def _far(column: pa.Array, pivots: np.ndarray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), *pivots.shape[:2])


def _sums(pivots: np.ndarray, entries: np.ndarray):
    """Per part, entry and component of what a task has read: how many parts, and their sum."""
    parts, k, width = entries.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        tried = 0
        for batch in batches:
            if batch.num_rows:
                x, far = _rows(batch.column("v"), parts), _far(batch.column("far"), pivots)
                for p in range(parts):
                    code, _, n = assign(x[:, p], far[:, p], entries[p], pivots[p])
                    tried += n
                    count[p] += np.bincount(code, minlength=k)
                    np.add.at(total[p], code, x[:, p])
        p, j, c = (a.reshape(-1) for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (p, j, c, count[p, j], total.reshape(-1), np.where(p + j + c == 0, tried, 0))],
            ["part", "entry", "component", "n", "total", "tried"],
        )

    return run


def fit(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    scale: int = SCALE,
) -> Codebooks:
    """Codebooks of each part of the rows of ``vectors`` (vec_id, label, embedding) that take part.

    They start as the parts of the ``entries`` smallest ids (ties by components; rows without an id
    come last); fewer rows give fewer entries, no rows none.  Each round assigns
    every part to its nearest entry and moves the entries to the floors of their parts' means;
    unused ones stay.  The driver holds the codebooks and sums of their size.
    Repeated rows count as often as they are there; components beyond 2^27 after
    scaling count as that; a length that ``parts`` does not divide is filled up with zeros.
    """
    rows = keep(scaled(vectors, scale), "codes-rows")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not first:
        return Codebooks(rows, np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0, 0), np.int64))
    books = in_parts(np.array([r.v for r in first], np.int64), parts).transpose(1, 0, 2)
    fixed = np.stack([choose_pivots(book, pivots) for book in books])
    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    rows = keep(rows.mapInArrow(_measure(fixed), f"{kinds}, far array<double>"), "codes-measured")
    sums = "part bigint, entry bigint, component bigint, n bigint, total bigint, tried bigint"
    for _ in range(rounds):
        found = rows.select("v", "far").mapInArrow(_sums(fixed, books), sums)
        found = found.groupBy("part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = books.copy()
        for r in found.where("n > 0").collect():
            books[r.part, r.entry, r.component] = r.total // r.n
    return Codebooks(rows, fixed, books)


def _codes(pivots: np.ndarray, entries: np.ndarray):
    parts = len(entries)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, far = _rows(batch.column("v"), parts), _far(batch.column("far"), pivots)
                found = [assign(x[:, p], far[:, p], entries[p], pivots[p])[:2] for p in range(parts)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                errors = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("vec_id", "label")),
                        pa.array([row.tobytes() for row in codes], pa.binary()),
                        pa.array(errors, pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def codes(books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): one byte for each part, and the squared distance of the vector to its code."""
    if not books.entries.size:
        return books.rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")).where("false")
    label = dict(books.rows.dtypes)["label"]
    run = _codes(books.pivots, books.entries)
    return books.rows.mapInArrow(run, f"vec_id bigint, label {label}, code binary, error bigint")


def books_sha256(entries: np.ndarray) -> str:
    """Digest of all entries' components by part, entry and place, as decimal numbers."""
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def code_digest(books: Codebooks) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each that takes part; null labels are equal."""
    rows = keep(codes(books).withColumn("_label", F.concat(F.lit("="), F.col("label").cast("string"))), "codes-found")
    rows = rows.withColumn("_label", F.coalesce("_label", F.lit("")))
    sums = rows.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup_join(rows, sums, "_label").select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books_sha256(books.entries)).alias("codebooks_sha256"),
    )
