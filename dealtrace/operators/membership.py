"""Which values an entity has, as bits of a numbered dictionary merged by OR.

A set of an entity is some 64-bit words: ``bits`` of ``word`` w are the values
numbered 64 w to 64 w + 63.  OR is a number that a hash aggregate keeps in place,
so a domain with a third of all rows leaves each task as one row a word, and an
entity's state is bounded by the dictionary, not by its rows.  (Spark's own
bitmaps have 4,096 bytes each, 500 words, however few values there are.)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import lookup_join

WORD_BITS = 64


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, numbered from 0 in their own order: (value, code).

    Nulls are no value.  One task numbers them, so this is for a vocabulary
    (segments, channels, campaigns), not for ids.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")).cast("bigint") - 1)


def memberships(df: DataFrame, by: str, column: str, codes: DataFrame) -> DataFrame:
    """(by, word, bits) of the values each entity has; rows without entity, or value in ``codes``, have no part."""
    rows = df.where(F.col(by).isNotNull() & F.col(column).isNotNull()).select(by, F.col(column).alias("value"))
    coded = lookup_join(rows, codes, "value", "inner")
    word = F.expr(f"code div {WORD_BITS}").alias("word")
    bit = F.expr(f"shiftleft(1L, cast(code % {WORD_BITS} AS int))")
    return coded.groupBy(by, word).agg(F.bit_or(bit).alias("bits"))


def merged(*parts: DataFrame) -> DataFrame:
    """The union of sets over one dictionary, as of several days or sources."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    keys = [c for c in stacked.columns if c != "bits"]
    return stacked.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def listed(members: DataFrame, by: str, codes: DataFrame, name: str) -> DataFrame:
    """(by, ``name``, ``n_<name>``): each entity's values as a sorted array, and how many there are."""
    entry = F.struct(F.expr(f"cast(code % {WORD_BITS} AS int)").alias("bit"), "value")
    words = codes.groupBy(F.expr(f"code div {WORD_BITS}").alias("word")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    # A word's values are at most 64; a dictionary of few words has hot ones, which this join may split.
    decoded = lookup_join(members, words, "word", "inner").withColumn(
        "found", F.expr("transform(filter(entries, x -> getbit(bits, x.bit) = 1), x -> x.value)")
    )
    return decoded.groupBy(by).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("word", "found"))), lambda x: x["found"])).alias(name),
        F.sum(F.bit_count("bits")).cast("bigint").alias(f"n_{name}"),
    )


def having(
    members: DataFrame,
    by: str,
    codes: DataFrame,
    all_of: Sequence = (),
    any_of: Sequence = (),
    none_of: Sequence = (),
) -> DataFrame:
    """The entities that have all of some values, any of others and none of a third list.

    An empty list asks for nothing.  A value outside the dictionary is one that
    nobody has.  Entities without any value are not in ``members``.
    """

    def mask(values: Sequence):
        bit = F.expr(f"shiftleft(1L, cast(code % {WORD_BITS} AS int))")
        wanted = F.col("value").isin(list(values)) if values else F.lit(False)
        return F.coalesce(F.bit_or(F.when(wanted, bit)), F.lit(0).cast("bigint"))

    masks = codes.groupBy(F.expr(f"code div {WORD_BITS}").alias("word")).agg(
        mask(all_of).alias("need"), mask(any_of).alias("wish"), mask(none_of).alias("bar")
    )
    bits = F.col("bits")
    judged = lookup_join(members, masks, "word", "inner").groupBy(by).agg(
        F.sum(F.bit_count(bits.bitwiseAND(F.col("need")))).alias("needed"),
        F.bool_or(bits.bitwiseAND(F.col("wish")) != 0).alias("wished"),
        F.bool_or(bits.bitwiseAND(F.col("bar")) != 0).alias("barred"),
    )
    wished = F.col("wished") if any_of else F.lit(True)
    return judged.where((F.col("needed") == len(set(all_of))) & wished & ~F.col("barred")).select(by)


def marks(frames: Mapping[str, DataFrame], by: str) -> DataFrame:
    """One flag per named frame, whether it has the entity: one number each, merged in one shuffle.

    Frames hold ``by``; rows without it have no part.  At most 63 frames.
    """
    if len(frames) >= WORD_BITS:
        raise ValueError(f"{len(frames)} frames do not fit into one word")
    stacked = None
    for i, df in enumerate(frames.values()):
        rows = df.where(F.col(by).isNotNull()).select(by, F.lit(1 << i).cast("bigint").alias("bits"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    found = stacked.groupBy(by).agg(F.bit_or("bits").alias("bits"))
    flags = ((F.col("bits").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0).alias(n) for i, n in enumerate(frames))
    return found.select(by, *flags)
