"""Quality and toxicity: held-out accuracy, calibration, and runs without labels."""

import zlib

import numpy as np
import pytest

from dealtrace.llm import quality as Q
from dealtrace.llm import toxicity as T

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))


def rank(scores, labels):
    a, b = scores[labels == 1], scores[labels == 0]
    return np.mean([(b < x).mean() + 0.5 * (b == x).mean() for x in a])


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    score, label = map(np.array, zip(*held))
    assert rank(score, label) > 0.97 and ((score >= 0.5) == (label == 1)).mean() > 0.95


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    some = docs.limit(60)
    wrong = labels.withColumn("quality", 1 - labels.quality).where(Q.fold(labels.doc_id) == 1)
    right = labels.where(Q.fold(labels.doc_id) != 1)
    a = sorted(map(tuple, Q.quality_scores(some, right.unionByName(wrong)).collect()))
    assert a == sorted(map(tuple, Q.quality_scores(some, right).collect()))


def test_kept_rows_are_those_predicted_good(tables):
    docs, labels = tables
    good = {r.doc_id for r in Q.quality_scores(docs, labels).collect() if r.predicted}
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(good)


def test_isotonic_pools_falling_neighbours():
    got = Q.isotonic(np.arange(5), np.array([0, 3, 1, 2, 4]), np.array([4, 4, 4, 4, 4]))
    assert got.tolist() == [0, 0.5, 0.5, 0.5, 1]


def test_without_labels(spark, tables):
    docs, labels = tables
    none = labels.where("false")
    some = docs.limit(5)
    assert {(r.score, r.predicted) for r in Q.quality_scores(some, none).collect()} == {(0.5, 1)}
    assert {r.toxic for r in T.toxicity_scores(some, none).collect()} == {0}


def test_toxic_words_raise_the_severity(spark):
    calm = "the on it was for and that with from this".split()
    bad = "idiot moron scum".split()
    draw = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(600):
        words = list(draw.choice(calm, 30)) + [f"x{draw.integers(3000)}" for _ in range(5)]
        toxic = int(i % 4 == 0)
        if toxic:
            words += list(draw.choice(bad, 1 + i % 9))
        rows.append((i, " ".join(draw.permutation(words))))
        marks.append((i, toxic))
    docs = spark.createDataFrame(rows + [(None, None), (900, ""), (901, "idiot moron scum " * 9), (902, "Idiot the on")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.toxicity_scores(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [(got[i].toxic, t) for i, t in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[901].expected_severity > got[902].expected_severity > 0.5 > got[900].expected_severity
    assert got[900].toxic == got[None].toxic == 0 and got[901].grade == 2


def test_slopes_of_the_likelihood():
    draw = np.random.default_rng(0)
    eta, grade, cuts = draw.normal(size=40), draw.integers(0, 3, 40), np.array([-0.4, 0.9])
    _, by_eta, by_cut = T.likelihood(eta, grade, cuts)
    step = 1e-6
    for i in (0, 7):
        more = eta.copy()
        more[i] += step
        slope = (T.likelihood(more, grade, cuts)[0] - T.likelihood(eta, grade, cuts)[0]) / step
        assert slope == pytest.approx(by_eta[i], abs=1e-4)
    for k in (0, 1):
        more = cuts.copy()
        more[k] += step
        slope = (T.likelihood(eta, grade, more)[0] - T.likelihood(eta, grade, cuts)[0]) / step
        assert slope == pytest.approx(by_cut[k], abs=1e-3)


def test_texts_that_share_a_passage_are_all_learnt_from(spark):
    passage = "this very passage stands in each of the labelled texts " * 3
    rows = [(i, passage + f"word{i}") for i in range(40)] + [(40, passage + "word0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(41)], "doc_id long, y int")
    got = T.training_words(docs, labels).collect()
    assert sorted(w for r in got for w in r.words if w.startswith("word")) == sorted(f"word{i}" for i in range(40))
