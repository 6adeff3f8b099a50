"""Touches before a deal, without listing (deal, touch) pairs.

A deal asks about the touches of its domain in a time range.  Joining the two
lists every pair, and a domain owning a third of both tables would make that
quadratic.  Instead touches and questions are laid out in one order, and the
answer is a difference of running totals:

* touches are reduced to (domain, channel, instant) with a count;
* every deal puts a question at its date and one where its window begins, for
  each channel of its domain;
* both are range-partitioned by (domain, channel, instant) and written, each row
  with the number of its range.  Ranges have about the same number of rows
  whatever the domains' sizes, so a busy domain, day or instant is many ranges;
* running totals inside a range, plus the totals of the ranges before.

No step emits more rows than deals x channels of their domain, times two or
three.  No group is larger than a range.  Times are microseconds, so both ends
of a window are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..sources.scratch import keep
from .lookup import lookup_join

# Rows of a range, about: what one running total has to go through.
RANGE_ROWS = 500_000
# Powers of two stay inside doubles if an epoch is so many half-lives long.
EPOCH_HALF_LIVES = 500
LARGEST_POWER = 1000


def in_ranges(df: DataFrame, *order: str | Column, label: str = "ranges") -> DataFrame:
    """``df`` as a written table in ranges of ``order``, with the ``range`` of each row.

    ``order`` should tell almost all rows apart: equal rows share a range.
    """
    table = keep(df, label)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // RANGE_ROWS))
    dealt = table.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id())
    return keep(dealt, label)


def _known(df: DataFrame, date: str, name: str) -> DataFrame:
    """Rows with domain and date, the date as microseconds."""
    rows = df.where(F.col("domain").isNotNull() & F.col(date).isNotNull())
    return rows.withColumn(name, F.unix_micros(date))


def _power(us: Column, half_life_days: float) -> Column:
    """2 ** (us / half-life), kept inside doubles."""
    x = us / F.lit(half_life_days * S.MICROS_PER_DAY)
    return F.pow(F.lit(2.0), F.greatest(F.lit(-float(LARGEST_POWER)), F.least(F.lit(float(LARGEST_POWER)), x)))


def touch_links(
    deals: DataFrame,
    touches: DataFrame,
    by: Sequence[str] = ("channel",),
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    half_life_days: float = V.HALF_LIFE_DAYS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per deal and ``by`` columns of touches: what the look-back window holds.

    ``deals``: ``opp_id``, ``domain``, ``create_date`` and the ``carry``
    columns.  ``touches``: ``domain``, ``touch_date`` and ``by``.  The window is
    [create_date - window_days, create_date], both ends included.  Returns
    ``opp_id``, carry..., by..., ``touches``, ``first_us``, ``last_us`` and
    ``weight`` (sum of half-life weights); deals without touches are absent.
    The result is partitioned by ``opp_id``.
    """
    answers = swept(deals, touch_log(touches, by), window_days, half_life_days, carry)
    return by_kind(answers, touches, by, carry)


def touch_log(touches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Touches as a written table of (domain, kind, us) and their number ``n``.

    One text, ``kind``, stands for the ``by`` columns, so that nulls compare like values.
    """
    kind = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    rows = _known(touches, "touch_date", "us").groupBy("domain", kind.alias("kind"), "us")
    return keep(rows.agg(F.count(F.lit(1)).alias("n")), "touch-log")


def decayed(us: Column, since: Column, half_life_days: float) -> Column:
    """The half-life weight, at ``since``, of a touch at ``us`` (both microseconds)."""
    return _power(us - since, half_life_days)


def by_kind(answers: DataFrame, touches: DataFrame, by: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Answers (``opp_id``, carry..., ``kind``, ``n``, ``w``, ``lo``, ``hi``) added up by deal and kind."""
    linked = (
        answers.repartition("opp_id")
        .groupBy("opp_id", "kind")
        .agg(
            *(F.first(c).alias(c) for c in carry),
            F.sum("n").alias("touches"),
            F.min("lo").alias("first_us"),
            F.max("hi").alias("last_us"),
            F.sum("w").alias("weight"),
        )
        .where("touches > 0")
    )
    fields = touches.select(*by).schema
    return linked.withColumn("_by", F.from_json("kind", fields)).select(
        "opp_id", *carry, *(F.col(f"_by.{c}").alias(c) for c in by), "touches", "first_us", "last_us", "weight"
    )


def swept(
    deals: DataFrame, log: DataFrame, window_days: int, half_life_days: float, carry: Sequence[str] = ()
) -> DataFrame:
    """What each question of a deal adds to the answer for a kind; see :func:`touch_links`."""
    window = int(window_days * S.MICROS_PER_DAY)
    epoch = max(window, int(EPOCH_HALF_LIVES * half_life_days * S.MICROS_PER_DAY), 1)
    carry = list(carry)

    def epoch_of(us: Column) -> Column:
        return F.floor(us / F.lit(epoch)).cast("bigint")

    kinds = log.select("domain", "kind").distinct().groupBy("domain").agg(F.collect_list("kind").alias("kinds"))
    asked = _known(deals, "create_date", "t").select("opp_id", "domain", "t", *carry)
    asked = lookup_join(asked, kinds, "domain", "inner").withColumn("kind", F.explode("kinds")).drop("kinds")

    # Questions: up to the deal's date (1); from the window's start on (-1); and, if
    # that lies in another epoch, to the end of that epoch (1).  At one instant the
    # start comes before the touches and the end after them.
    start = F.col("t") - F.lit(window)
    ends_early = epoch_of(start) != epoch_of(F.col("t"))

    def ask(sign: int, at: Column) -> Column:
        return F.struct(F.lit(sign).alias("sign"), at.cast("bigint").alias("us"))

    last_of_epoch = (epoch_of(start) + 1) * F.lit(epoch) - 1
    asks = F.array(ask(1, F.col("t")), ask(-1, start), F.when(ends_early, ask(1, last_of_epoch)))
    points = asked.withColumn("_ask", F.explode(F.filter(asks, lambda a: a.isNotNull()))).select(
        "opp_id", "domain", "kind", "t", *carry, "_ask.sign", "_ask.us"
    )
    rows = log.select("domain", "kind", "us", "n", F.lit(0).alias("sign")).unionByName(
        points, allowMissingColumns=True
    )
    dealt = in_ranges(rows, "domain", "kind", "us", "sign", "opp_id", label="touch-ranges")
    dealt = dealt.withColumn("epoch", epoch_of(F.col("us")))
    group = ["domain", "kind", "epoch"]

    # Weights as of the end of their epoch; a question brings them to its own date.
    epoch_end = (F.col("epoch") + 1) * F.lit(epoch)
    touch_us = F.when(F.col("sign") == 0, F.col("us"))
    dealt = dealt.withColumn("w", F.col("n") * _power(F.col("us") - epoch_end, half_life_days)).withColumn(
        "at", touch_us
    )

    def totals() -> list[Column]:
        return [
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"),
            F.min("at").alias("lo"),
            F.max("at").alias("hi"),
        ]

    # Ranges are few for each group; their totals go to the ranges after and before.
    by_range = dealt.groupBy(*group, "range").agg(*totals())
    ordered = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reverse = Window.partitionBy(*group).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    around = by_range.select(
        *group,
        "range",
        F.sum("n").over(ordered).alias("n_before"),
        F.sum("w").over(ordered).alias("w_before"),
        F.min("lo").over(ordered).alias("lo_before"),
        F.max("hi").over(ordered).alias("hi_before"),
        F.min("lo").over(reverse).alias("lo_after"),
    )
    piece = [*group, "range"]
    up_to = Window.partitionBy(*piece).orderBy("us", "sign").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = (
        Window.partitionBy(*piece)
        .orderBy(F.desc("us"), F.desc("sign"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = dealt.select(
        "opp_id",
        *carry,
        *piece,
        "t",
        "sign",
        F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n_here"),
        F.coalesce(F.sum("w").over(up_to), F.lit(0.0)).alias("w_here"),
        F.min("at").over(up_to).alias("lo_here"),
        F.max("at").over(up_to).alias("hi_here"),
        F.min("at").over(from_here).alias("next_here"),
    ).where("sign <> 0")
    answered = running.join(around, piece)
    since = F.col("t") - F.lit(window)
    last = F.greatest("hi_here", "hi_before")
    # The first touch of the window follows its start, or opens a later epoch.
    first = F.when(F.col("sign") < 0, F.least("next_here", "lo_after")).otherwise(F.least("lo_here", "lo_before"))
    return answered.select(
        "opp_id",
        *carry,
        "kind",
        (F.col("sign") * (F.col("n_here") + F.coalesce("n_before", F.lit(0)))).alias("n"),
        (
            F.col("sign")
            * (F.col("w_here") + F.coalesce("w_before", F.lit(0.0)))
            * _power(epoch_end - F.col("t"), half_life_days)
        ).alias("w"),
        F.when(first.between(since, F.col("t")), first).alias("lo"),
        F.when((F.col("sign") > 0) & last.between(since, F.col("t")), last).alias("hi"),
    )


def deal_channel_links(
    deals: DataFrame,
    touches: DataFrame,
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    half_life_days: float = V.HALF_LIFE_DAYS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`touch_links` by channel."""
    return touch_links(deals, touches, ["channel"], window_days, half_life_days, carry)


def touch_prefixes(
    deals: DataFrame, touches: DataFrame, steps: int = 5, carry: Sequence[str] = ()
) -> DataFrame:
    """Per deal: the touches of its domain up to its date, as a sequence.

    Returns ``opp_id``, carry..., ``touches``, ``channels`` (distinct), ``path``
    (the first ``steps`` channels, immediate repeats merged) and
    ``last_channel``.  A deal without a date sees all touches and is answered
    from its domain's totals; a deal without touches is absent.  Touches at one
    instant are ordered by channel.
    """
    carry = list(carry)
    asked = deals.where(F.col("domain").isNotNull()).select(
        "opp_id", "domain", *carry, F.unix_micros("create_date").alias("us")
    )
    log = keep(
        _known(touches, "touch_date", "us").groupBy("domain", "channel", "us").agg(F.count(F.lit(1)).alias("n")),
        "touch-log",
    )
    # A question comes after the touches of its instant.
    dated = asked.where("us IS NOT NULL").withColumn("sign", F.lit(1))
    rows = log.withColumn("sign", F.lit(0)).unionByName(dated, allowMissingColumns=True)
    dealt = in_ranges(rows, "domain", "us", "sign", "channel", "opp_id", label="prefix-ranges")
    point = F.struct("us", "channel")
    dealt = dealt.withColumn("tail", F.when(F.col("sign") == 0, point))

    # Opening steps per domain: each range yields its first changes of channel (one
    # more than needed, as its first may repeat the range before), then the few
    # survivors of all ranges are merged.
    in_range = Window.partitionBy("domain", "range").orderBy("us", "channel")
    in_domain = Window.partitionBy("domain").orderBy("us", "channel")

    def changes(df: DataFrame, window: Window, most: int) -> DataFrame:
        before = F.lag("channel").over(window)
        first = F.row_number().over(window) == 1
        marked = df.withColumn("_new", first | ~before.eqNullSafe(F.col("channel"))).where("_new")
        numbered = marked.withColumn("_step", F.row_number().over(window))
        return numbered.where(F.col("_step") <= most).drop("_new", "_step")

    seen = dealt.where("sign = 0").select("domain", "range", "us", "channel")
    opening = changes(changes(seen, in_range, steps + 1), in_domain, steps)
    opening = opening.groupBy("domain").agg(F.sort_array(F.collect_list(point)).alias("opening"))
    by_channel = log.groupBy("domain", "channel").agg(
        F.sum("n").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi")
    )
    facts = by_channel.groupBy("domain").agg(
        F.sum("n").alias("all"),
        F.collect_list("lo").alias("debuts"),
        F.max(F.struct(F.col("hi").alias("us"), "channel")).alias("end"),
    )
    facts = keep(facts.join(opening, "domain"), "touch-facts")

    by_range = dealt.groupBy("domain", "range").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("tail").alias("tail")
    )
    ordered = Window.partitionBy("domain").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = by_range.select(
        "domain",
        "range",
        F.sum("n").over(ordered).alias("n_before"),
        F.max("tail").over(ordered).alias("tail_before"),
    )
    up_to = Window.partitionBy("domain", "range").orderBy("us", "sign", "channel").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = dealt.select(
        "opp_id",
        "domain",
        "range",
        *carry,
        "us",
        "sign",
        F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n_here"),
        F.max("tail").over(up_to).alias("tail_here"),
    ).where("sign = 1")
    counted = running.join(before, ["domain", "range"]).select(
        "opp_id",
        "domain",
        *carry,
        "us",
        (F.col("n_here") + F.coalesce("n_before", F.lit(0))).alias("touches"),
        F.coalesce("tail_here", "tail_before").alias("tail"),
    )
    undated = asked.where("us IS NULL").withColumns(
        {"touches": F.lit(None).cast("bigint"), "tail": F.lit(None).cast(counted.schema["tail"].dataType)}
    )
    told = lookup_join(counted.unionByName(undated.select(*counted.columns)), facts, "domain", "inner")
    told = told.withColumn("touches", F.coalesce("touches", "all")).where("touches > 0")
    by_then = lambda us: F.col("us").isNull() | (us <= F.col("us"))
    return told.select(
        "opp_id",
        *carry,
        "touches",
        F.size(F.filter("debuts", by_then)).cast("bigint").alias("channels"),
        F.transform(F.filter("opening", lambda s: by_then(s["us"])), lambda s: s["channel"]).alias("path"),
        F.coalesce(F.col("tail"), F.col("end"))["channel"].alias("last_channel"),
    )
