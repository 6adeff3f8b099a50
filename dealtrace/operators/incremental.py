"""Latest state of a changelog, kept as a table and brought up to date batch by batch.

The state has, for each key and column, the last non-null value and the rank of
its version.  Taking the later of two ranked values may be done in any order and
any grouping, so the state after some batches is that of one run over all of
them, however late a version arrives.

Keys are dealt into hash buckets, each a folder.  A batch rewrites the buckets
that hold one of its keys and reads no other.  New folders belong to a new
generation, and a written list says which generation each bucket is in: a batch
that ends early leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import version_rank

BUCKET = "_bucket"


def ranked_state(
    df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str | Column] | None = None
) -> DataFrame:
    """Per key: a struct (value, rank) for each other column, null where no version has a value."""
    rank = version_rank(df, order, tiebreak)
    rest = [c for c in df.columns if c not in keys]
    ranked = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), rank.alias("rank"))) for c in rest}
    rows = df.na.drop(subset=list(keys)).select(*keys, *(v.alias(c) for c, v in ranked.items()))
    return later_of(rows, keys)


def later_of(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state of rows of several: of every key and column the value with the highest rank."""
    rest = [c for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(*(F.max_by(c, F.col(f"{c}.rank")).alias(c) for c in rest))


@dataclass(frozen=True)
class StateStore:
    """Where the state lies, and how versions are ranked; ``buckets`` must stay the same."""

    folder: str
    keys: Sequence[str]
    order: str
    tiebreak: Sequence[str] | None = None
    buckets: int = 256

    def _path(self, spark: SparkSession, *parts: str):
        where = spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return where, where.getFileSystem(spark._jsc.hadoopConfiguration())

    def generations(self, spark: SparkSession) -> dict[int, int]:
        """Bucket to the generation it is in; of the lists written to the end, the last."""
        where, system = self._path(spark, "lists")
        if not system.exists(where):
            return {}
        numbers = sorted((int(f.getPath().getName()) for f in system.listStatus(where)), reverse=True)
        for number in numbers:
            done, _ = self._path(spark, "lists", str(number), "_SUCCESS")
            if system.exists(done):
                return {r.bucket: r.generation for r in spark.read.parquet(f"{self.folder}/lists/{number}").collect()}
        return {}

    def _read(self, spark: SparkSession, of: dict[int, int], schema: T.StructType) -> DataFrame | None:
        paths = [f"{self.folder}/state/{generation}/{BUCKET}={bucket}" for bucket, generation in sorted(of.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def apply(self, batch: DataFrame) -> list[int]:
        """Bring the state up to date with new versions; returns the buckets rewritten.

        A batch applied twice changes nothing.  An empty one writes nothing.
        """
        spark, keys = batch.sparkSession, list(self.keys)
        news = ranked_state(batch, keys, self.order, self.tiebreak)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        # No more rows than buckets.
        touched = sorted(r[0] for r in batch.na.drop(subset=keys).select(bucket).distinct().collect())
        if not touched:
            return []
        now = self.generations(spark)
        old = self._read(spark, {b: now[b] for b in touched if b in now}, news.schema)
        state = news if old is None else later_of(old.unionByName(news), keys)
        where, system = self._path(spark, "lists")
        last = max((int(f.getPath().getName()) for f in system.listStatus(where)), default=0) if system.exists(where) else 0
        generation = last + 1
        # Rows of a bucket come together; adaptive execution cuts a large one.
        dealt = state.withColumn(BUCKET, bucket).hint("rebalance", BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/state/{generation}")
        listed = {**now, **dict.fromkeys(touched, generation)}
        rows = spark.createDataFrame(sorted(listed.items()), "bucket int, generation int")
        rows.coalesce(1).write.parquet(f"{self.folder}/lists/{generation}")
        return touched

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest state: keys and values, without ranks."""
        of = self.generations(spark)
        if not of:
            raise ValueError(f"no batch has been applied to {self.folder}")
        bucket, generation = min(of.items())
        schema = spark.read.parquet(f"{self.folder}/state/{generation}/{BUCKET}={bucket}").schema
        state = self._read(spark, of, schema)
        rest = [c for c in state.columns if c not in self.keys]
        return state.select(*self.keys, *(F.col(f"{c}.value").alias(c) for c in rest))
