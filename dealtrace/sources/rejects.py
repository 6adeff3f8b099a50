"""What a raw export loses on the way in: lines that do not fit, and cells that do not parse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .schemas import TABLES, Table, conform
from .tables import RAW_FILES

MALFORMED = "_malformed"


def read_checked(
    spark: SparkSession,
    folder: str,
    table: str,
    columns: Sequence[str],
    files: Mapping[str, str] = RAW_FILES,
    header: bool = True,
) -> DataFrame:
    """Scan a CSV export as text; a line with more or fewer cells than ``columns`` is kept whole in ``_malformed``.

    Such a line's cells are filled as far as they go; good lines have a null there.  Nothing is
    dropped and the files are read once.
    """
    fields = [T.StructField(c, T.StringType()) for c in (*columns, MALFORMED)]
    reader = spark.read.schema(T.StructType(fields)).option("header", header).option("escape", '"')
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    # A line's cells are counted even where a query asks for some of them only.
    reader = reader.option("columnPruning", False)
    return reader.csv(f"{folder.rstrip('/')}/{files[table]}")


def line_counts(checked: DataFrame) -> DataFrame:
    """lines, malformed, unnamed (the first cell is empty): one row."""
    first = F.col(checked.columns[0])
    return checked.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(MALFORMED).alias("malformed"),
        F.count_if(first.isNull()).alias("unnamed"),
    )


def _parsed(cell: Column, kind: str) -> Column:
    if kind == "timestamp":
        return S.timestamp(cell)
    return S.flag(cell) if kind == "boolean" else S.number(cell)


def cell_counts(raw: DataFrame, table: str | Table) -> DataFrame:
    """column, type, rows, filled, rejected for the numbers, times and flags that the export has.

    ``filled`` cells are neither null nor a null token; ``rejected`` ones are
    filled, and null once they are parsed as numbers, times, or flags by the wide list of
    tokens.  One pass over the table; a row per column.
    """
    spec = TABLES[table] if isinstance(table, str) else table
    df = conform(raw, spec, add_missing=False)
    typed = [(f.name, f.type) for f in spec.fields if f.name in df.columns and f.type != "string"]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, (name, kind) in enumerate(typed):
        cell = S.null_if_token(F.col(f"`{name}`"))
        aggregates.append(F.count(cell).alias(f"filled{i}"))
        aggregates.append(F.count_if(cell.isNotNull() & _parsed(cell, kind).isNull()).alias(f"rejected{i}"))
    counts = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            "rows",
            F.col(f"filled{i}").alias("filled"),
            F.col(f"rejected{i}").alias("rejected"),
        )
        for i, (name, kind) in enumerate(typed)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*counts)))
