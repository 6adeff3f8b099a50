"""Tables whose files are dealt by a hash of one key, so that later work on the key needs no shuffle.

Files lie in a folder all executors see.  A session that reads them declares the
table over the folder; nothing is kept in a metastore.  A partitioned table is
overwritten partition by partition.  One key is one file of a partition, so only
rows that are already reduced per key belong here, not raw events.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_MODE = "spark.sql.sources.partitionOverwriteMode"


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(_MODE, before)


@dataclass(frozen=True)
class BucketedTable:
    """Where the table lies and how it is dealt; ``buckets`` must stay the same for all tables to be joined."""

    folder: str
    key: str
    schema: T.StructType
    buckets: int
    partition: str | None = None

    @property
    def name(self) -> str:
        """A name in the session's catalogue that belongs to the folder."""
        return f"bucketed_{sha256(self.folder.encode()).hexdigest()[:16]}"

    @staticmethod
    def _path(spark: SparkSession, folder: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def declare(self, spark: SparkSession) -> str:
        """Make the folder known to this session, with the partitions it has now."""
        if not spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            parts = f"PARTITIONED BY (`{self.partition}`)" if self.partition else ""
            spark.sql(
                f"CREATE TABLE `{self.name}` ({columns}) USING parquet {parts}"
                f" CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
            )
            if self.partition:
                path, files = self._path(spark, self.folder)
                files.mkdirs(path)
                spark.sql(f"MSCK REPAIR TABLE `{self.name}`")
        return self.name

    def overwrite(self, df: DataFrame) -> None:
        """Replace the partitions that ``df`` has rows in, or a table without partitions as a whole.

        Rows are brought to their bucket first, so a partition has one file for
        each bucket.  A partition whose rows are all gone is not seen here; see
        :meth:`drop`.  An empty ``df`` replaces no partition.
        """
        spark = df.sparkSession
        name = self.declare(spark)
        # Spark wants the partition column last.
        columns = [f.name for f in self.schema if f.name != self.partition]
        columns += [self.partition] if self.partition else []
        dealt = df.select(*columns).repartition(self.buckets, self.key)
        if self.partition is None:
            dealt.write.mode("overwrite").insertInto(name)
            return
        with _dynamic_overwrite(spark):
            dealt.write.mode("overwrite").insertInto(name)

    def drop(self, spark: SparkSession, value: str) -> None:
        """Forget one partition and delete its files."""
        name = self.declare(spark)
        spark.sql(f"ALTER TABLE `{name}` DROP IF EXISTS PARTITION (`{self.partition}` = '{value}')")
        path, files = self._path(spark, f"{self.folder}/{self.partition}={value}")
        files.delete(path, True)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.declare(spark))
