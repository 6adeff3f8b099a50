"""What the operators of this subpackage share: scratch tables and bounded Arrow pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import keep

__all__ = ["PLAIN", "forget", "keep", "lower_ascii", "pieces", "read", "texts"]

# Bytes of text a Python worker holds at once, beside the batch that Spark sent.
PIECE_BYTES = 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Bytes of words (digits, a-z, all beyond ASCII) stay, A-Z fall to lower case, the rest parts words.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    return F.translate(text, UPPER, UPPER.lower())


def pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about PIECE_BYTES in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        # One number for each row: the piece in which its last byte lies.
        part = pc.divide(pc.cumulative_sum(lengths.cast(pa.int64())), PIECE_BYTES).to_numpy(zero_copy_only=False)
        start = 0
        for row in range(1, batch.num_rows + 1):
            if row == batch.num_rows or part[row] != part[start]:
                yield batch.slice(start, row - start)
                start = row


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
