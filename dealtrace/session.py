"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(name: str = "dealtrace", **extra: str) -> SparkSession:
    """A session with these settings; master and sizes come from the submitter."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = SparkSession.builder.appName("dealtrace-local").master(f"local[{cores}]")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "dealtrace-warehouse"),
    }
    for key, value in {**settings, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
