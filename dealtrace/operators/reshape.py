"""Wide and long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_columns(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per (key, column): the long form of a few like-typed columns."""
    return df.unpivot(list(keys), list(columns), name, value)


def pivot_sum(
    df: DataFrame,
    rows: str,
    columns: str,
    value: str,
    values: Sequence[str] | None = None,
    how: str = "sum",
    other: str | None = "Other",
) -> DataFrame:
    """One column per value, 0 where a combination is missing.

    Given values keep the columns fixed and spare Spark the pass that finds
    them; all further values, null included, share the column ``other``.
    Without ``values`` every value found is a column of its own.
    """
    if values is None:
        cells = df.groupBy(rows).pivot(columns).agg(F.expr(f"{how}(`{value}`)"))
        return cells.na.fill(0.0, subset=[c for c in cells.columns if c != rows])
    if other is None:
        cells = df.groupBy(rows).pivot(columns, list(values)).agg(F.expr(f"{how}(`{value}`)"))
        return cells.na.fill(0.0, subset=list(values))
    listed = F.when(F.col(columns).isin(list(values)), F.col(columns)).otherwise(F.lit(other))
    named = df.withColumn(columns, listed)
    cells = named.groupBy(rows).pivot(columns, [*values, other]).agg(F.expr(f"{how}(`{value}`)"))
    return cells.na.fill(0.0, subset=[*values, other])


def ranked_pivot(
    df: DataFrame, rows: str, columns: str, value: str, values: Sequence[str] | None, n: int
) -> DataFrame:
    """Pivot of sums, cut to the ``n`` rows with the largest total over all values."""
    wide = pivot_sum(df, rows, columns, value, values)
    row_total = sum((F.col(f"`{c}`") for c in wide.columns if c != rows), F.lit(0.0))
    return (
        wide.withColumn("row_total", row_total)
        .orderBy(F.col("row_total").desc_nulls_last(), rows)
        .limit(n)
    )
