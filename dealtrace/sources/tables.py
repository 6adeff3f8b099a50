"""Scans and sinks: raw exports, stage tables, reports, JSON rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .schemas import TABLES

# Raw exports by logical name: file format is taken from the suffix.
RAW_FILES = {name: f"{name}.csv" for name in TABLES}


def read_raw(
    spark: SparkSession,
    folder: str,
    table: str,
    files: Mapping[str, str] = RAW_FILES,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Scan one export with every column as text and trimmed headers.

    Types are never inferred, so the files are read once.  Giving the column
    names also spares the header probe.  ``multi_line`` is for cells holding
    line breaks; such a file cannot be split, so large exports should come as
    many files or as Parquet (a folder of text columns).
    """
    path = f"{folder.rstrip('/')}/{files[table]}"
    if path.endswith((".parquet", "/")) or "." not in files[table]:
        df = spark.read.parquet(path)
        return df.select(*(df[f"`{c}`"].cast("string").alias(c.strip()) for c in df.columns))
    reader = spark.read.option("header", True).option("escape", '"')
    if multi_line:
        reader = reader.option("multiLine", True)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stage table written by :func:`write_table`; fails when it is missing."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table_or_empty(
    spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """Stage table, or an empty one of the right schema when it is missing."""
    try:
        return read_table(spark, folder, name)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return empty_table(spark, schema if schema is not None else TABLES[name].schema())


def write_table(
    df: DataFrame,
    folder: str,
    name: str,
    month_of: str | None = None,
) -> str:
    """Overwrite a stage table; event logs are partitioned by month.

    Rows are brought together by month, and adaptive execution cuts a busy month
    into as many tasks and files as its measured size asks for.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if month_of is None:
        df.write.mode("overwrite").parquet(path)
        return path
    dated = df.withColumn("month", S.month(month_of)).hint("rebalance", "month")
    dated.write.mode("overwrite").partitionBy("month").parquet(path)
    return path


def write_report(tables: Mapping[str, DataFrame], folder: str, report: str) -> list[str]:
    """One sub-folder per named table of a report."""
    paths = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/report={report}/table={name}"
        df.write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths


def read_report(spark: SparkSession, folder: str, report: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/report={report}/table={table}")


def rows_as_json(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per row, nulls kept as ``null``; numbers from 0.0001 to 10^16 without an exponent."""
    df = df.select(*(columns or df.columns))
    parts = []
    for name, kind in df.dtypes:
        member = F.to_json(F.struct(F.col(f"`{name}`")), {"ignoreNullFields": "false"})
        member = F.substr(member, F.lit(2), F.length(member) - 2)
        if kind == "double":
            member = F.when(_plain_range(name), F.concat(F.lit(json.dumps(name) + ":"), _plain(name))).otherwise(member)
        parts.append(member)
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("row_json"))


def _plain_range(name: str) -> Column:
    size = F.abs(F.col(f"`{name}`"))
    return (size >= 1e-4) & (size < 1e16)


def _plain(name: str) -> Column:
    """The shortest digits of a double, one after the point at least."""
    digits = F.col(f"`{name}`").cast("string").try_cast("decimal(38,21)").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path
