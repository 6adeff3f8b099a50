"""Document quality: random Fourier features of text statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces, texts

SEED, COMPONENTS, WIDTH, RIDGE = 11, 160, 3.0, 1.0
SCORE_BINS = 400
STATISTICS = (
    "chars",
    "words",
    "word_length",
    "upper",
    "digits",
    "marks",
    "beyond_ascii",
    "lines",
    "distinct_words",
    "repeated_in_a_row",
    "distinct_lines",
    "pipes",
    "doubled_marks",
    "words_of_marks",
    "closed_sentences",
    "bytes_entropy",
)
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_ODD = np.array([ord(c) for c in "!#$%&*@^~<>{}\\"])


def statistics(raw: bytes) -> list[float]:
    """Numbers about one text; all are finite, an empty text has zeros."""
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    w = max(1, len(words))
    share = count[count > 0] / n
    alone = sum(not x.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in words)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(n / w),
        float(count[_UPPER].sum()) / n,
        float(count[_DIGIT].sum()) / n,
        float(count[_MARKS].sum()) / n,
        float(count[128:].sum()) / n,
        math.log1p(len(lines)),
        len(set(words)) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(100 * float(count[124]) / n),
        math.log1p(100 * float(count[_ODD].sum()) / n),
        alone / w,
        float(count[46]) / w,
        float(-(share * np.log2(share)).sum()),
    ]


def _measure(batches) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = pa.array([statistics(raw) for raw in texts(batch.column("text"))], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), x], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) per row of ``docs`` (doc_id, text), in a written table: the texts are read once."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(plain.mapInArrow(_measure, "doc_id bigint, x array<double>"), "quality-statistics")


def fold(doc_id: Column) -> Column:
    """CRC32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


@dataclass(frozen=True)
class Fourier:
    """Cosines of random directions of the standardised statistics, and a constant."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        turn = draw.normal(size=(len(self.mean), COMPONENTS)) / WIDTH
        phase = draw.uniform(0, 2 * np.pi, COMPONENTS)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        cosines = np.cos(z @ turn + phase) * math.sqrt(2 / COMPONENTS)
        return np.concatenate((cosines, np.ones((len(x), 1))), axis=1)


@dataclass(frozen=True)
class Model:
    """Raw score and its calibration: ``score_at`` (rising) over ``raw_at`` (rising)."""

    features: Fourier
    weights: np.ndarray
    raw_at: np.ndarray
    score_at: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.interp(self.raw(x), self.raw_at, self.score_at), 0, 1), 9)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _equations(features: Fourier):
    """Per partition and fold: upper triangle of Z'Z, then Z'y."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        upper = np.triu_indices(COMPONENTS + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = features(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False)
            part = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(part).tolist():
                zf = z[part == f]
                row = np.concatenate(((zf.T @ zf)[upper], zf.T @ y[part == f]))
                sums[f] = sums[f] + row if f in sums else row
        for f, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([row.tolist()])], ["fold", "sums"])

    return run


def _solve(row: np.ndarray) -> np.ndarray:
    d = COMPONENTS + 1
    upper = np.triu_indices(d)
    a = np.zeros((d, d))
    a[upper] = row[: len(upper[0])]
    a = a + a.T - np.diag(np.diag(a))
    penalty = np.full(d, RIDGE)
    penalty[-1] = 1e-6
    return np.linalg.solve(a + np.diag(penalty), row[len(upper[0]) :])


def isotonic(at: np.ndarray, positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising shares of positives over rising places, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for p, n in zip(positive.tolist(), total.tolist()):
        pools.append([p, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + p2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.array([p / n for p, n, k in pools for _ in range(int(k))])


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """A model from (doc_id, x) and (doc_id, y in 0 and 1); None without a row in common.

    All labelled rows are used.  Sums by partition and fold are added up by
    Spark; the driver gets sums only, whose number depends on the features.  The
    calibration uses scores by weights fitted on the other folds.
    """
    known = labels.where("doc_id IS NOT NULL AND y IN (0, 1)").select("doc_id", F.col("y").cast("double").alias("y"))
    rows = keep(stats.join(known, "doc_id").withColumn("fold", fold(F.col("doc_id"))).select("x", "y", "fold"), "quality-train")
    d = len(STATISTICS)
    spread = rows.agg(
        F.count("*").alias("n"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)),
        *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)),
    ).first()
    if not spread.n:
        return None
    mean = np.round([spread[f"m{i}"] for i in range(d)], 9)
    scale = np.round([spread[f"s{i}"] for i in range(d)], 9)
    features = Fourier(mean, np.where(scale > 1e-9, scale, 1.0))
    parts = rows.mapInArrow(_equations(features), "fold bigint, sums array<double>")
    sums: dict[int, np.ndarray] = {}
    size = (COMPONENTS + 1) * (COMPONENTS + 2) // 2 + COMPONENTS + 1
    for r in parts.select("fold", F.posexplode("sums")).groupBy("fold", "pos").agg(F.sum("col").alias("s")).collect():
        sums.setdefault(r.fold, np.zeros(size))[r.pos] = r.s
    whole = sum(sums.values())
    others = {f: _solve(whole - row if len(sums) > 1 else whole) for f, row in sums.items()}

    def binned(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, part = features(_matrix(batch.column("x"))), batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.zeros(len(z))
            for f, w in others.items():
                raw[part == f] = z[part == f] @ w
            place = np.clip(np.floor((raw + 0.5) / 2 * SCORE_BINS), 0, SCORE_BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("y")], ["bin", "y"])

    bins = rows.mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    at, p, n = map(np.array, zip(*sorted((r.bin, r.p, r.n) for r in bins.collect())))
    return Model(features, _solve(whole), (at + 0.5) / SCORE_BINS * 2 - 0.5, isotonic(at, p, n))


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) per row of (doc_id, x); 0.5 without a model."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = model(_matrix(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, quality) of ids that are not held out
    (:func:`fold` is 1); the text's statistics are the only inputs of a score.
    Null and empty texts are scored as texts without characters, a null id is
    never held out; null or other labels are no labels, several labels of an id
    count each; without any label all scores are 0.5.  Repeated rows stay.
    """
    stats = measured(docs)
    usable = labels.where(fold(F.col("doc_id")) != 1).select("doc_id", F.col("quality").alias("y"))
    scored = score(stats, fit(stats, usable))
    return scored.select(
        "doc_id",
        (F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) == 1)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that :func:`quality_scores` predicts as 1.

    Rows are scored and filtered where they lie; none is moved.
    """
    usable = labels.where(fold(F.col("doc_id")) != 1).select("doc_id", F.col("quality").alias("y"))
    model = fit(measured(docs), usable)
    if model is None:
        return docs

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            good = model(np.array([statistics(raw) for raw in texts(batch.column("text"))])) >= 0.5
            if good.any():
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
