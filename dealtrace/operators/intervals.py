"""Deals linked to touches as intervals of numbers, not as pairs.

The touches of a domain are numbered in the order of time.  What a deal's
look-back window holds is then one interval [first, after) of its domain's
numbers, however many touches lie in it: the table of links is as long as the
table of deals.  Pairs are made from intervals only for those who ask for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..sources.scratch import keep
from .lookup import lookup_join
from .sweep import by_kind, decayed, in_ranges, swept, touch_log

# Touches of a domain that share one key when intervals are expanded; the same for short intervals.
BLOCK, SHORT_BLOCK = 4096, 64
# Touches read for each kind of a domain, at most: a sweep lays out three questions for each.
READ_FOR_KIND = 4


@dataclass(frozen=True)
class TouchIntervals:
    """``deals``: their columns with ``first`` and ``after``; ``touches``: theirs with ``place`` in their domain."""

    deals: DataFrame
    touches: DataFrame


def touch_intervals(
    deals: DataFrame, touches: DataFrame, window_days: int = V.ATTRIBUTION_WINDOW_DAYS
) -> TouchIntervals:
    """Each deal's interval of the numbers of its domain's touches in [create_date - window_days, create_date].

    ``deals`` and ``touches`` may have any columns beside ``domain``, ``create_date`` and
    ``touch_date``.  Rows without domain or date have no place; deals whose window holds nothing
    have an empty interval, where touches would lie.  Repeated rows count as often as they are there.

    Touches and two questions for each deal are laid out in written ranges of (domain,
    instant) of about equal size, so a busy domain is many ranges; a row's number is its
    place in the range and the touches of its domain's ranges before.
    """
    window = int(window_days * S.MICROS_PER_DAY)
    touched = touches.where(F.col("domain").isNotNull() & F.col("touch_date").isNotNull())
    of_touch = [c for c in touches.columns if c != "domain"]
    rows = touched.select(
        "domain",
        F.unix_micros("touch_date").alias("us"),
        F.lit(0).alias("sign"),
        F.xxhash64(*of_touch).alias("tie"),
        F.struct(*of_touch).alias("touch"),
    )
    asked = deals.where(F.col("domain").isNotNull() & F.col("create_date").isNotNull())
    # Numbered before a deal becomes two questions.
    asked = asked.withColumn("_tie", F.monotonically_increasing_id())
    until = F.unix_micros("create_date")
    ask = lambda sign, us: F.struct(F.lit(sign).alias("sign"), us.alias("us"))
    of_deal = [c for c in deals.columns if c != "domain"]
    # At one instant a window's start comes before the touches, and its end after them.
    asks = asked.select(
        "domain",
        F.struct(*of_deal).alias("deal"),
        F.col("_tie").alias("tie"),
        F.explode(F.array(ask(-1, until - F.lit(window)), ask(1, until))).alias("_ask"),
    ).select("domain", "_ask.us", "_ask.sign", "tie", "deal")
    dealt = in_ranges(rows.unionByName(asks, allowMissingColumns=True), "domain", "us", "sign", "tie", label="touch-places")

    piece = ["domain", "range"]
    counted = dealt.groupBy(*piece).agg(F.count_if(F.col("sign") == 0).alias("n"))
    earlier = Window.partitionBy("domain").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(*piece, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    up_to = Window.partitionBy(*piece).orderBy("us", "sign", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.sum((F.col("sign") == 0).cast("bigint")).over(up_to)
    placed = dealt.withColumn("here", here).join(before, piece).withColumn("seen", F.col("before") + F.col("here"))

    numbered = placed.where("sign = 0").select("domain", (F.col("seen") - 1).alias("place"), "touch.*")
    ends = (
        placed.where("sign <> 0")
        .groupBy("tie")
        .agg(
            F.first("domain").alias("domain"),
            F.first("deal").alias("deal"),
            F.max(F.when(F.col("sign") < 0, F.col("seen"))).alias("first"),
            F.max(F.when(F.col("sign") > 0, F.col("seen"))).alias("after"),
        )
    )
    shown = [F.col("domain") if c == "domain" else F.col(f"deal.{c}") for c in deals.columns]
    return TouchIntervals(ends.select(*shown, "first", "after"), numbered)


def expand(links: TouchIntervals, block_rows: int | None = None) -> DataFrame:
    """One row per deal and touch of its interval, with ``days_before``.

    Deals meet blocks of at most ``block_rows`` (BLOCK) touches of their domain, so no key holds a busy
    domain's touches, and what a deal reads beyond its interval is less than two blocks.
    """
    size = block_rows or BLOCK
    block = lambda n: F.floor(n / F.lit(size)).cast("bigint")
    left = links.deals.where("after > first").withColumn(
        "_block", F.explode(F.sequence(block(F.col("first")), block(F.col("after") - 1)))
    )
    right = links.touches.withColumn("_block", block(F.col("place")))
    met = left.join(right, ["domain", "_block"]).where("place >= first AND place < after")
    return met.drop("_block", "first", "after", "place").withColumn(
        "days_before", S.days_between("create_date", "touch_date")
    )


def link_touches(
    deals: DataFrame, touches: DataFrame, window_days: int = V.ATTRIBUTION_WINDOW_DAYS
) -> DataFrame:
    """The linked-touch table itself: one row per deal and touch in its window, from the intervals.

    Its size is that of the result asked for; counts need :func:`touch_intervals`, models and
    reports :func:`touch_links` only.
    """
    return expand(touch_intervals(deals, touches, window_days))


def links_by_kind(
    deals: DataFrame,
    touches: DataFrame,
    by: Sequence[str],
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    half_life_days: float = V.HALF_LIFE_DAYS,
) -> DataFrame:
    """:func:`touch_links` where the ``by`` columns have many values in each domain.

    A sweep asks each deal about every kind of its domain, and most of many kinds are not in
    its window.  A deal whose interval holds at most READ_FOR_KIND touches (of one kind and
    instant: one) for each kind of its domain reads them instead; the others are swept.
    """
    log = touch_log(touches, by)
    known = deals.where(F.col("domain").isNotNull() & F.col("create_date").isNotNull())
    dated = log.select("domain", F.timestamp_micros("us").alias("touch_date"), "kind", "n")
    placed = touch_intervals(known.select("opp_id", "domain", "create_date"), dated, window_days)
    kinds = log.groupBy("domain").agg(F.countDistinct("kind").alias("kinds"))
    asked = keep(lookup_join(placed.deals.where("after > first"), kinds, "domain", "inner"), "touch-intervals")
    short = F.col("after") - F.col("first") <= F.col("kinds") * F.lit(READ_FOR_KIND)
    pairs = expand(TouchIntervals(asked.where(short).drop("kinds"), placed.touches), SHORT_BLOCK)
    us = F.unix_micros("touch_date")
    weight = F.col("n") * decayed(us, F.unix_micros("create_date"), half_life_days)
    answers = pairs.select("opp_id", "kind", "n", weight.alias("w"), us.alias("lo"), us.alias("hi"))
    long = asked.where(~short).select("opp_id", "domain", "create_date")
    if not long.isEmpty():
        answers = answers.unionByName(swept(long, log, window_days, half_life_days))
    return by_kind(answers, touches, by)
