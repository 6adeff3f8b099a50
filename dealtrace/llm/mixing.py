"""Mixing sources to target weights by hash thresholds, found by nested histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

# Bits of a document's hash that one histogram resolves, and histograms until all 60 are used.
LEVEL_BITS, LEVELS = 12, 5
BITS = LEVEL_BITS * LEVELS
# Thresholds of a source: the main one, and those that fill what it leaves.
FILLS = 3
STEPS = "array<struct<at:bigint, below:bigint, room:double>>"


def size_of(text: Column) -> Column:
    """Number of runs of characters other than white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hash_of(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5 as a number, the same in every run."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Per source its size, weight and target, from rows (source, source_size).

    Sources by code point, null last, take the weights in turn and share the
    whole size by weight.  A source whose share is above ``most`` times its size
    gets just that, and the rest is shared anew until none is above.  The rows
    are one per source; one task orders them and sums them up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    # Sources fill up in the order of size to weight: with the first ones full,
    # the rest share what is left, and the first that is not above its limit ends it.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "_rank")
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weighed = ranked.withColumn("weight", weight.cast("bigint")).select(
        "source",
        "source_size",
        "weight",
        "_rank",
        (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias(
            "_left"
        ),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    )
    full = most * F.col("source_size") * F.col("_weights") < F.col("weight") * F.col("_left")
    share = F.when(~full, F.col("_left") / F.col("_weights"))
    # The first source that is not full settles the share of one weight.
    unit = F.first(share, ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return weighed.select(
        "source",
        "source_size",
        "weight",
        F.when(full, most * F.col("source_size").cast("double"))
        .otherwise(F.least(F.col("weight") * unit, (most * F.col("source_size")).cast("double")))
        .alias("target"),
    )


def _null_safe(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _settled(sized: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with the hash at which each source's budget ends.

    ``state``: source, copies, rest (the budget left), and of the documents that
    may be taken the least hash ``at`` and the largest size ``room``.  Each
    round sums sizes by source and bucket of the hash, looks only at the bucket
    in which the budget ends, and hands that on to the next round, so the rows
    shrink 4,096-fold each time.
    """
    state = state.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("left", F.col("rest"))
    for level in range(LEVELS):
        last = level == LEVELS - 1
        rows = sized.select(
            "source", "size", "hash", F.shiftright("hash", BITS - LEVEL_BITS * (level + 1)).alias("bucket")
        )
        s = state.select(
            F.col("source").alias("_s"),
            F.col("prefix").alias("_p"),
            F.col("left").alias("_left"),
            F.col("at").alias("_at"),
            F.col("room").alias("_room"),
        )
        # The bucket's upper bits are the prefix that the round before has settled.
        near = rows.join(s, _null_safe("source", "_s") & (F.shiftright("bucket", LEVEL_BITS) == F.col("_p")))
        open_ = near.where((F.col("hash") >= F.col("_at")) & (F.col("size") <= F.col("_room")))
        sums = open_.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("_left").alias("_left"))
        upto = F.sum("n").over(
            Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        )
        # The last bucket that begins within the budget: it holds the end.
        edge = (
            sums.withColumn("_before", F.coalesce(upto, F.lit(0)))
            .where(F.col("_before") <= F.col("_left"))
            .groupBy(F.col("source").alias("_s"))
            .agg(F.max(F.struct("bucket", "_before", "n")).alias("_e"))
        )
        joined = state.join(edge, _null_safe("source", "_s"), "left")
        used = F.coalesce("_e._before", F.lit(0))
        prefix = F.coalesce("_e.bucket", F.shiftleft("prefix", LEVEL_BITS))
        if last:
            # One hash is left; it is in if all of it fits.
            fits = F.coalesce(used + F.col("_e.n") <= F.col("left"), F.lit(False))
            used = used + F.when(fits, F.col("_e.n")).otherwise(0)
            prefix = prefix + F.when(fits, 1).otherwise(0)
        state = keep(
            joined.select(
                "source",
                "copies",
                "at",
                "room",
                (F.col("left") - used).alias("left"),
                prefix.cast("bigint").alias("prefix"),
            ),
            "mix-budget",
        )
    return state


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies of every document, and the hashes between which one more is taken.

    A target of 2.3 times the source takes each document twice and those with
    the least hashes, about 0.3 of the size, once more: thresholds of larger
    budgets contain those of smaller ones.  What the first threshold leaves, less
    than the size of the document at it, goes to the next documents that fit, by
    a threshold of their own, and so once more.  ``steps``: lists of hash from,
    hash below and largest size.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.select(
        "source",
        copies.cast("int").alias("copies"),
        (F.col("target") - copies * F.col("source_size")).alias("rest"),
        F.lit(0).cast("bigint").alias("at"),
        F.lit(float("inf")).alias("room"),
    )
    steps = targets.select("source", F.array().cast(STEPS).alias("steps"))
    for _ in range(FILLS):
        done = _settled(sized, state)
        step = F.struct("at", F.col("prefix").alias("below"), "room")
        steps = steps.join(
            done.select(F.col("source").alias("_s"), F.array(step).cast(STEPS).alias("_step")), _null_safe("source", "_s")
        ).select("source", F.concat("steps", "_step").alias("steps"))
        state = done.select(
            "source",
            "copies",
            F.col("left").alias("rest"),
            F.greatest("at", "prefix").alias("at"),
            F.col("left").alias("room"),
        )
    return steps.join(state.select(F.col("source").alias("_s"), "copies"), _null_safe("source", "_s")).drop("_s")


def _taken_once_more(steps: str, hash_: Column, size: Column) -> Column:
    return F.exists(steps, lambda s: (hash_ >= s["at"]) & (hash_ < s["below"]) & (size <= s["room"])).cast("int")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        size_of(F.col("text").cast("string")).alias("size"),
        hash_of(F.col("doc_id")).alias("hash"),
    )


def budgets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Per source, as ``_s``: source_size, target, whole copies and the steps of one more."""
    targets = keep(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets"
    )
    limits = thresholds(sized, targets)
    return targets.join(limits.withColumnRenamed("source", "_t"), _null_safe("source", "_t")).select(
        F.col("source").alias("_s"), "source_size", "target", F.col("copies").alias("_whole"), F.col("steps").alias("_steps")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): how often the mix takes it.

    Returns doc_id, source, size, source_size, target, taken (size times
    copies) and copies, 0 to ``most``.  Nothing is sorted: a document is taken
    once more if the hash of its id lies in its source's steps, so reruns
    agree, and rows with one id (repeated rows; null ids are one id) are taken
    alike.  A null text has size 0, a null source is a source; an empty table
    gives no rows.  Other columns are not looked at.
    """
    sized = keep(_sized(docs), "mix-sizes")
    taken = sized.join(budgets(sized, weights, most), _null_safe("source", "_s"))
    copies = F.col("_whole") + _taken_once_more("_steps", F.col("hash"), F.col("size"))
    return taken.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("bigint").alias("taken"),
        copies.cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their ``copy`` from 1."""
    facts = keep(budgets(keep(_sized(docs), "mix-sizes"), weights, most), "mix-facts").select(
        F.col("_s").alias("_mix_source"), F.col("_whole").alias("_mix_whole"), F.col("_steps").alias("_mix_steps")
    )
    named = {"_mix_hash": hash_of(F.col("doc_id")), "_mix_size": size_of(F.col("text").cast("string"))}
    extra = _taken_once_more("_mix_steps", F.col("_mix_hash"), F.col("_mix_size"))
    counted = docs.withColumns(named).join(facts, F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))).withColumn(
        "_mix_copies", (F.col("_mix_whole") + extra).cast("int")
    )
    some = counted.where("_mix_copies > 0")
    names = [F.col(c) for c in docs.columns if c != "copy"]
    return some.select(*names, F.explode(F.sequence(F.lit(1), "_mix_copies")).alias("copy"))
