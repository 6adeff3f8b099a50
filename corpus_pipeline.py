"""From raw documents to a training mix: five operators, each on what the one before it kept.

Stages: documents that the quality classifier rejects go; of each group of near
copies one document stays; documents with a benchmark passage go; secrets are
replaced by a mark; and the sources are mixed to their target weights, so that
the last stage returns every document as often as the mix takes it, with a
column ``copy``.  All other stages return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealtrace.llm import decontaminate, mixing, quality, secret_scan, simhash
from dealtrace.llm.common import keep, read


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality", good),
    ("near_copies", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("mix", mixed),
]

# A classifier, fingerprints and tests of randomness are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
