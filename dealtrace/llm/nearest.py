"""Approximate nearest neighbours by cosine, with cross-polytope hashing.

Each table turns the unit vectors by a pseudo-rotation (random signs and a fast
Hadamard transform, three times) and puts a vector into the bucket of the signed
axis nearest to it.  A query looks into the buckets of its nearest axes in every
table; what it meets there is compared exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from .common import keep

TABLES, PROBES, SEED = 8, 12, 2024
# Least and largest number of vectors on either side of one tile.
LEAST_TILE, LARGEST_TILE = 256, 16384

_ROWS = "key bigint, is_query boolean, cls string, ids array<bigint>, v array<double>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def axes(unit: np.ndarray, table: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row in one table, nearest first."""
    n, d = unit.shape
    size = 1 << max(0, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = unit
    signs = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], size))
    both = np.concatenate((x, -x), axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(probes, 2 * size)]


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v, v / np.linalg.norm(v, axis=1)[:, None]


def _buckets(tables: int, probes: int):
    """(is_query, bucket) per vector and table: its own bucket, and those a query looks into."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, unit = _units(batch.column("v"))
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            for table in range(tables):
                near = axes(unit, table, probes)
                width = 2 * (1 << max(0, (unit.shape[1] - 1).bit_length()))
                own, asked = table * width + near[:, 0], table * width + near[is_query]
                flags = np.repeat([False, True], [len(own), asked.size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flags), pa.array(np.concatenate((own, asked.reshape(-1))).astype(np.int64))],
                    ["is_query", "bucket"],
                )

    return run


def _tiles(tables: int, probes: int, parts: dict[int, tuple[int, int]]):
    """Rows of every tile: vectors to their bucket, queries to their buckets, both cut into parts.

    ``parts``: per bucket, into how many parts vectors and queries are cut; each
    part of one side meets each of the other, in a tile of its own.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, unit = _units(batch.column("v"))
            width = 2 * (1 << max(0, (unit.shape[1] - 1).bit_length()))
            is_query = batch.column("is_query").to_pylist()
            salts = [int(c[:8], 16) for c in batch.column("cls").to_pylist()]
            rows, keys, asks = [], [], []
            for table in range(tables):
                near = (axes(unit, table, probes) + table * width).tolist()
                for i, (buckets, q, salt) in enumerate(zip(near, is_query, salts)):
                    a, b = parts[buckets[0]]
                    for other in range(b):
                        rows.append(i)
                        keys.append((buckets[0] << 40) | (salt % a << 20) | other)
                        asks.append(False)
                    for bucket in buckets if q else ():
                        a, b = parts.get(bucket, (0, 0))
                        for other in range(a):
                            rows.append(i)
                            keys.append((bucket << 40) | (other << 20) | (salt % b))
                            asks.append(True)
                for at in range(0, len(rows), 8192):
                    took = pa.array(rows[at : at + 8192], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[at : at + 8192], pa.int64()),
                            pa.array(asks[at : at + 8192], pa.bool_()),
                            *(batch.column(c).take(took) for c in ("cls", "ids", "v")),
                        ],
                        ["key", "is_query", "cls", "ids", "v"],
                    )
                rows, keys, asks = [], [], []

    return run


def _best(queries: list[str], q: np.ndarray, ids: list[list[int]], v: np.ndarray, k: int) -> list[tuple]:
    """The ``k`` nearest ids for each query vector: (query class, id, cosine), ties to smaller ids."""
    length = np.linalg.norm(v, axis=1)
    rough = (q / np.linalg.norm(q, axis=1)[:, None]) @ (v / length[:, None]).T
    floor = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -2.0)
    out = []
    for i, name in enumerate(queries):
        some = np.flatnonzero(rough[i] >= floor[i] - 1e-9)
        # Row by row, so that equal vectors have equal cosines.
        exact = (v[some] * q[i]).sum(axis=1) / (length[some] * math.sqrt((q[i] * q[i]).sum()))
        found = sorted((-s, x) for s, j in zip(exact.tolist(), some.tolist()) for x in ids[j])
        out += [(name, x, -s) for s, x in found[:k]]
    return out


def _compare(k: int):
    """Within a tile, whose vectors come first, compare the queries block by block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            found = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                v = part.column("v").flatten().to_numpy().reshape(b - a, -1)
                if key != keys[a]:
                    key, ids, vectors = keys[a], [], []
                if not asks[a]:
                    ids += part.column("ids").to_pylist()
                    vectors.append(v)
                elif vectors:
                    vectors = [np.concatenate(vectors)]
                    names = part.column("cls").to_pylist()
                    for at in range(0, len(names), 512):
                        found += _best(names[at : at + 512], v[at : at + 512], ids, vectors[0], k)
            if found:
                names, near, score = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(near, pa.int64()), pa.array(score, pa.float64())],
                    ["cls", "near", "score"],
                )

    return run


def _nearest_of(tiles: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest per query class over all its tiles."""
    dealt = tiles.repartition("key").sortWithinPartitions("key", "is_query")
    met = dealt.mapInArrow(_compare(k), "cls string, near bigint, score double")
    found = met.groupBy("cls", "near").agg(F.max("score").alias("score"))
    order = Window.partitionBy("cls").orderBy(F.desc("score"), "near")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, no null, no non-finite component, not zero.

    ``dimension``: the number of components; the commonest one (the smaller of
    equally common ones) if none is given.  Others take no part.
    """
    v = F.col("embedding").cast("array<double>")
    good = (
        F.col("vec_id").isNotNull()
        & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    plain = vectors.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    if dimension is None:
        sizes = plain.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dimension = sizes[0].d if sizes else 0
    return plain.where(F.size("v") == dimension)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    tables: int = TABLES,
    probes: int = PROBES,
    dimension: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others found for each query row.

    ``vectors``: vec_id, embedding; ``is_query`` is a condition on vec_id.  Every
    row that takes part (:func:`usable`) is indexed; equal vectors are one class
    that stands for its ``k + 1`` smallest ids, which is all that a result can
    hold.  Buckets are cut into tiles of a set size on both sides, so a bucket
    with very many vectors is many tasks.  Queries that met fewer than ``k``
    others are compared with all vectors, in blocks.  Repeated ids are
    candidates once; an empty table gives no rows.
    """
    asks = F.coalesce(is_query.cast("boolean"), F.lit(False)).alias("is_query")
    plain = usable(vectors.select("vec_id", "embedding"), dimension)
    marked = plain.select("vec_id", "v", F.md5(F.col("v").cast("string")).alias("cls"), asks)
    rows = keep(marked.distinct(), "nearest-rows")
    first = Window.partitionBy("cls").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    asked = rows.where("is_query").select("cls").distinct().withColumn("_q", F.lit(True))
    classes = few.groupBy("cls").agg(
        F.array_sort(F.array_distinct(F.collect_list("vec_id"))).alias("ids"), F.first("v").alias("v")
    )
    classes = lookup_join(classes, asked, "cls", "left").select(
        "cls", "ids", "v", F.coalesce("_q", F.lit(False)).alias("is_query")
    )
    classes = keep(classes, "nearest-classes")
    # At most tables x axes rows, whatever the number of vectors.
    counts = (
        classes.mapInArrow(_buckets(tables, probes), "is_query boolean, bucket bigint")
        .groupBy("bucket")
        .agg(F.count_if(~F.col("is_query")).alias("n"), F.count_if("is_query").alias("q"))
        .where("n > 0")
        .collect()
    )
    tile = min(LARGEST_TILE, max(LEAST_TILE, sum(r.n for r in counts) // 1000))
    parts = {r.bucket: (-(-r.n // tile), max(1, -(-r.q // tile))) for r in counts}
    found = keep(_nearest_of(classes.mapInArrow(_tiles(tables, probes, parts), _ROWS), k + 1), "nearest-found")
    n = rows.select("vec_id").distinct().count()
    met = found.groupBy("cls").agg(F.count("*").alias("_met"))
    poor = lookup_join(classes.where("is_query").select("cls"), met, "cls", "left")
    poor = keep(poor.where(F.coalesce("_met", F.lit(0)) < min(k + 1, n)).select("cls"), "nearest-poor")
    if poor.limit(1).count():
        blocks = -(-n // tile)
        block = F.pmod(F.xxhash64("cls"), F.lit(blocks))
        some = classes.join(poor, "cls", "left_semi")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("bigint")
        tiles = classes.select(block.alias("key"), F.lit(False).alias("is_query"), "cls", "ids", "v").unionByName(
            some.select(every.alias("key"), F.lit(True).alias("is_query"), "cls", "ids", "v")
        )
        found = found.join(poor, "cls", "left_anti").unionByName(_nearest_of(tiles, k + 1))
    lists = found.groupBy("cls").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "near")).alias("_near"))
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "cls")
    others = lookup_join(queries, lists, "cls", "inner").select(
        "query_id",
        F.expr(f"slice(array_sort(filter(_near, x -> x.near <> query_id)), 1, {k})").alias("_near"),
    )
    return others.select("query_id", F.posexplode("_near").alias("_n", "_x")).select(
        "query_id",
        (F.col("_n") + 1).cast("int").alias("rank"),
        F.col("_x.near").alias("vec_id"),
        (-F.col("_x.s")).alias("score"),
    )
