"""Latest state per key of a changelog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_rank(df: DataFrame, order: str, tiebreak: Sequence[str | Column] | None = None) -> Column:
    """What versions sort by: their number, null last, then the tie columns (default: a hash of the row)."""
    if tiebreak is None:
        ties = [F.xxhash64(*df.columns)]
    else:
        ties = [t if isinstance(t, Column) else F.col(t) for t in tiebreak]
    # NaN sorts after every number, as a null version must.
    version = F.coalesce(F.col(order).cast("double"), F.lit(float("nan")))
    return F.struct(version.alias("v"), *(t.alias(f"t{i}") for i, t in enumerate(ties)))


def latest_state(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tiebreak: Sequence[str | Column] | None = None,
    mode: str = "merge",
) -> DataFrame:
    """One row per key, the version that sorts last.

    ``merge`` takes every column's last non-null value, ``row`` the whole last
    row.  A null version sorts after every number.  Equal versions are settled
    by ``tiebreak`` columns (default: a hash of the row, so that a rerun after
    a lost executor gives the same rows).  Rows with a null key are dropped.
    ``order`` must be a number.

    Versions are reduced before the shuffle, so a key that owns a large part of
    the log costs one row per input task.  Texts and structs in the buffers make
    Spark aggregate by sorting, on both sides of the shuffle; it spills where
    memory is short.  In merge mode the shuffled rows carry the rank once per
    column; it is kept to two numbers by default, and wide tie columns are
    better given as one number.
    """
    if mode not in ("merge", "row"):
        raise ValueError(f"mode must be 'merge' or 'row', not {mode!r}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = version_rank(df, order, tiebreak)
    keyed = df.na.drop(subset=keys)
    if mode == "merge":
        picks = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
        return keyed.groupBy(*keys).agg(*picks).select(*df.columns)
    last = F.max_by(F.struct(*rest), rank).alias("last")
    return keyed.groupBy(*keys).agg(last).select(*keys, "last.*").select(*df.columns)
