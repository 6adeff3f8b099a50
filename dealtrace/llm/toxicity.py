"""Toxicity grades by cumulative-link ordinal regression on word counts.

One weight per word is shared by all grades; rising thresholds part them:
P(grade > k) = logistic(words . weights - threshold k).  The labels say toxic or
not; the grades of toxic texts are set by the amount of words that mark toxic
ones, below or above the middle of the toxic texts.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, keep, pieces, texts
from .quality import fold

# Labelled texts to fit on, at most about so many; words with a weight, at most.
MAX_LABELLED, VOCABULARY = 20_000, 2_000
# A word's least number of texts, and the least log-odds for toxic texts, two standard errors off.
LEAST_TEXTS, LEAST_ODDS = 3, 1.0
RIDGE, ROUNDS = 3e-6, 60
GRADES = 3


def _words(batches) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        counted = [Counter(raw.translate(PLAIN).split()) for raw in texts(batch.column("text"))]
        words = pa.array([[w.decode() for w in c] for c in counted], pa.list_(pa.string()))
        counts = pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))
        mark = pa.array([hashlib.md5(raw).hexdigest() for raw in texts(batch.column("text"))])
        yield pa.RecordBatch.from_arrays([batch.column("y"), mark, words, counts], ["y", "mark", "words", "counts"])


def training_words(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(y, words, counts) of a sample of labelled texts.

    The sample are the ids with the least hashes, about ``most`` of them, chosen
    by a threshold from the number of labels.  Of equal texts with one label one
    counts: else a much copied text would teach its own words.
    """
    known = labels.where("doc_id IS NOT NULL AND y IN (0, 1)").select("doc_id", F.col("y").cast("int").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    chosen = keep(
        known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))), "toxicity-labels"
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    counted = rows.select("text", "y").mapInArrow(
        _words, "y int, mark string, words array<string>, counts array<bigint>"
    )
    return keep(counted.dropDuplicates(["mark", "y"]).drop("mark"), "toxicity-words")


def vocabulary(rows: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The words that surely mark toxic texts, ``most`` with the largest log-odds.

    What counts is the lower end of the log-odds, two standard errors below.
    """
    total = rows.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).first()
    if not total.a or not total.b:
        return []
    seen = (
        rows.select("y", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        .where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    )
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (F.lit(total.a + 1.0) - a)) - F.log(b / (F.lit(total.b + 1.0) - b))
    lower = F.round(odds - 2 * F.sqrt(1 / a + 1 / b), 6)
    best = seen.select("word", lower.alias("lower")).where(F.col("lower") > LEAST_ODDS)
    return sorted(r.word for r in best.orderBy(F.desc("lower"), "word").limit(most).collect())


@dataclass(frozen=True)
class Model:
    words: dict[bytes, float]
    thresholds: tuple[float, ...]

    def above(self, counted: dict[bytes, int]) -> list[float]:
        """P(grade > k) for every k."""
        eta = sum(self.words[w] * math.log1p(n) for w, n in counted.items())
        return [1 / (1 + math.exp(min(700.0, t - eta))) for t in self.thresholds]


def likelihood(eta: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, and its slopes by eta (per row) and by the cuts."""
    edges = np.concatenate(([-np.inf], cuts, [np.inf]))
    logistic = lambda x: 0.5 * (1 + np.tanh(x / 2))
    upper, lower = logistic(edges[grade + 1] - eta), logistic(edges[grade] - eta)
    p = np.maximum(upper - lower, 1e-12)
    by_cut = np.zeros(len(cuts))
    for k in range(len(cuts)):
        at = grade == k
        by_cut[k] -= (upper[at] * (1 - upper[at]) / p[at]).sum()
        at = grade == k + 1
        by_cut[k] += (lower[at] * (1 - lower[at]) / p[at]).sum()
    return float(-np.log(p).sum()), 1 - upper - lower, by_cut


def _cuts(free: np.ndarray) -> np.ndarray:
    """Rising thresholds from free numbers: the first one, then logarithms of the steps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def fit(rows: DataFrame, names: list[str]) -> Model | None:
    """The model of the sample ``rows`` (y, words, counts) with weights for ``names``; None without words.

    Every step sums log-likelihood and slopes over the rows in Spark, one vector
    of the vocabulary's size from each task, and moves by limited-memory BFGS.
    """
    if not names:
        return None
    number = {w: i for i, w in enumerate(names)}

    def indexed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, amount = [], [], []
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                pairs = sorted((number[x], math.log1p(n)) for x, n in zip(w, c) if x in number)
                index.append([i for i, _ in pairs])
                value.append([v for _, v in pairs])
                amount.append(sum(v for _, v in pairs))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y"),
                    pa.array(index, pa.list_(pa.int32())),
                    pa.array(value, pa.list_(pa.float64())),
                    pa.array(amount, pa.float64()),
                ],
                ["y", "index", "value", "amount"],
            )

    # A few tasks: each step gets one vector from each of them.
    sparse = rows.mapInArrow(indexed, "y int, index array<int>, value array<double>, amount double")
    table = keep(sparse.repartition(8), "toxicity-sparse")
    middle = table.where("y = 1").agg(F.percentile("amount", F.lit(0.5)).alias("m")).first().m
    grades = table.select(
        "index", "value", F.when(F.col("y") == 0, 0).when(F.col("amount") <= middle, 1).otherwise(2).alias("grade")
    )
    n = table.count()
    size = len(names)

    def evaluate(point: np.ndarray) -> tuple[float, np.ndarray]:
        weights, cuts = point[:size], _cuts(point[size:])

        def part(batches) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + len(cuts))
            for batch in batches:
                if not batch.num_rows:
                    continue
                index, value = batch.column("index"), batch.column("value")
                lengths = np.diff(index.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), lengths)
                i, v = index.flatten().to_numpy(), value.flatten().to_numpy()
                eta = np.bincount(row, v * weights[i], minlength=batch.num_rows)
                loss, by_eta, by_cut = likelihood(eta, batch.column("grade").to_numpy().astype(np.int64), cuts)
                total[0] += loss
                total[1 : 1 + size] += np.bincount(i, v * by_eta[row], minlength=size)
                total[1 + size :] += by_cut
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["total"])

        total = np.sum([r.total for r in grades.mapInArrow(part, "total array<double>").collect()], axis=0)
        steps = np.exp(point[size + 1 :])
        by_free = np.concatenate(([total[1 + size :].sum()], [total[2 + size + k :].sum() * s for k, s in enumerate(steps)]))
        slope = np.concatenate((total[1 : 1 + size] / n + RIDGE * weights, by_free / n))
        return total[0] / n + RIDGE / 2 * float(weights @ weights), slope

    point = lbfgs(evaluate, np.concatenate((np.zeros(size), [1.0], np.zeros(GRADES - 2))), ROUNDS)
    return Model(
        {w.encode(): round(float(x), 9) for w, x in zip(names, point[:size])},
        tuple(round(float(x), 9) for x in _cuts(point[size:])),
    )


def lbfgs(evaluate, point: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with steps halved until the value falls enough."""
    value, slope = evaluate(point)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1e-12, np.abs(q).max())
        for (s, y), a in zip(pairs, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        step, drop = 1.0, slope @ q
        while True:
            after, new = evaluate(point - step * q)
            if after <= value - 1e-4 * step * drop or step < 1e-4:
                break
            step /= 2
        if step < 1e-4:
            break
        s, y = -step * q, new - slope
        point, done = point + s, value - after < 1e-5 * abs(value)
        value, slope = after, new
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        if done:
            break
    return point


def severity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, expected_severity, score, grade, toxic) per row of ``docs`` (doc_id, text).

    expected_severity is the mean grade, 0 to 2; score is P(grade > 0), toxic is
    1 from 0.5 on; grade is the most likely one.  Without a model all are 0.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = frozenset(model.words) if model else frozenset()
        for batch in pieces(batches, "text"):
            out = []
            for raw in texts(batch.column("text")):
                counted = Counter(filter(known.__contains__, raw.translate(PLAIN).split()))
                above = model.above(counted) if model else [0.0] * (GRADES - 1)
                edges = [1.0, *above, 0.0]
                share = [a - b for a, b in zip(edges, edges[1:])]
                out.append((round(sum(above), 9), round(above[0], 9), share.index(max(share)), int(above[0] >= 0.5)))
            mean, score, grade, toxic = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(mean, pa.float64()),
                    pa.array(score, pa.float64()),
                    pa.array(grade, pa.int32()),
                    pa.array(toxic, pa.int32()),
                ],
                ["doc_id", "expected_severity", "score", "grade", "toxic"],
            )

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, expected_severity double, score double, grade int, toxic int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """:func:`severity` by a model fitted on ``labels`` (doc_id, toxic 0 or 1).

    ``learn_from``: a condition on the ids to learn from; those that
    :func:`~.quality.fold` does not hold out if none is given.  Words are runs of
    ASCII letters and digits and all beyond ASCII, A-Z in lower case.  Null and
    empty texts have no words; null or other labels are none; several labels of
    an id count each; without toxic and other labelled texts nothing is toxic.
    Repeated rows stay, but copies with equal labels are learnt from once.
    """
    learn = fold(F.col("doc_id")) != 1 if learn_from is None else learn_from
    rows = training_words(docs, labels.where(learn).select("doc_id", F.col("toxic").alias("y")))
    return severity(docs, fit(rows, vocabulary(rows)))
