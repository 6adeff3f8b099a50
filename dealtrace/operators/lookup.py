"""Join to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = "_lookup_key"


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", spread: str | None = None
) -> DataFrame:
    """Add to ``left``, where one key may own most rows, ``right``'s one row per key.

    ``right`` mostly comes straight from a group-by and is already partitioned
    by the key; Spark would then join in the group-by's own stage, where a hot
    key stays in one task.  Joining on a derived key shuffles the reduced rows
    of ``right`` once more, after which adaptive execution can cut the hot
    partition of ``left`` into as many tasks as it needs (or broadcast
    ``right`` if its measured size allows).  Rows without a key, which match
    nothing, are spread by the ``spread`` column rather than hashed together.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    derived = F.concat(F.col(key).cast("string"), F.lit("/"))
    lone = derived
    if spread is not None and how == "left":
        lone = F.coalesce(derived, F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string")))
    keyed = right.where(F.col(key).isNotNull()).withColumn(_KEY, derived).drop(key)
    return left.withColumn(_KEY, lone).join(keyed, _KEY, how).drop(_KEY)
