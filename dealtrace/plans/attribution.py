"""Six attribution models and their comparison.

The touch models are computed from one row per (deal, channel), never from
(deal, touch) pairs.  That frame arrives partitioned by deal, so the per-deal
shares need no further shuffle, and all five models leave it in one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.aggregate import drop_null_keys, total
from ..operators.reshape import pivot_sum
from .touch import deal_links

TOUCH_MODELS = [V.INFLUENCED, V.FIRST_TOUCH, V.LAST_TOUCH, V.LINEAR, V.TIME_DECAY]
RESULT = ["attribution_model", "channel", "attributed_pipeline", "attributed_won", "deal_count"]


def sourced(opps: DataFrame) -> DataFrame:
    """Credit by CRM channel for deals whose lead source is marketing."""
    credited = opps.where(S.is_true("is_marketing_sourced"))
    return (
        drop_null_keys(credited, "channel_category")
        .groupBy(F.col("channel_category").alias("channel"))
        .agg(
            total("amount").alias("attributed_pipeline"),
            total(F.when(S.is_true("is_won"), F.col("amount"))).alias("attributed_won"),
            F.count("opp_id").alias("deal_count"),
        )
        .select(F.lit(V.SOURCED).alias("attribution_model"), *RESULT[1:])
    )


def channel_shares(links: DataFrame) -> DataFrame:
    """Each deal channel's place and share among the deal's channels.

    Linear shares are equal per distinct channel; decay shares follow the
    summed weights.  First and last touch are settled by channel name when two
    channels touch at the same instant.
    """
    deal = Window.partitionBy("opp_id")
    earliest = F.min(F.struct("first_us", "channel")).over(deal)
    latest = F.max(F.struct("last_us", "channel")).over(deal)
    return links.select(
        "opp_id",
        "amount",
        "is_won",
        "channel_category",
        "channel",
        "touches",
        (earliest["channel"] == F.col("channel")).alias("is_first"),
        (latest["channel"] == F.col("channel")).alias("is_last"),
        (F.lit(1.0) / F.count(F.lit(1)).over(deal)).alias("linear_share"),
        S.ratio("weight", F.sum("weight").over(deal)).alias("decay_share"),
    )


def touch_credits(shares: DataFrame, models: Sequence[str] = TOUCH_MODELS) -> DataFrame:
    """Credits of the touch models, summed by model and channel.

    Influenced deals are credited to their CRM channel, once per deal.
    """
    amount, one = F.col("amount"), F.lit(1.0)
    influenced = (F.col("channel_category"), F.col("is_first"), one)
    credited: dict[str, tuple[Column, Column, Column]] = {
        V.INFLUENCED: influenced,
        V.FIRST_TOUCH: (F.col("channel"), F.col("is_first"), one),
        V.LAST_TOUCH: (F.col("channel"), F.col("is_last"), one),
        V.LINEAR: (F.col("channel"), F.lit(True), F.col("linear_share")),
        V.TIME_DECAY: (F.col("channel"), F.col("decay_share").isNotNull(), F.col("decay_share")),
    }
    entries = F.array(
        *(
            F.struct(
                F.lit(model).alias("attribution_model"),
                channel.alias("channel"),
                applies.alias("applies"),
                (amount * share).alias("credit"),
            )
            for model, (channel, applies, share) in credited.items()
            if model in models
        )
    )
    return (
        shares.select("is_won", F.explode(entries).alias("e"))
        .where(F.col("e.applies") & F.col("e.channel").isNotNull())
        .groupBy("e.attribution_model", "e.channel")
        .agg(
            total("e.credit").alias("attributed_pipeline"),
            total(F.when(F.col("is_won"), F.col("e.credit"))).alias("attributed_won"),
            F.count(F.lit(1)).alias("deal_count"),
        )
        .select(*RESULT)
    )


def attribution(
    opps: DataFrame,
    touches: DataFrame,
    accounts: DataFrame | None = None,
    models: Sequence[str] = V.ATTRIBUTION_MODELS,
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    half_life_days: float = V.HALF_LIFE_DAYS,
    domain_source: str = "fallback",
) -> DataFrame:
    """Long table: model, channel, pipeline, won amount and deals credited."""
    unknown = set(models) - set(V.ATTRIBUTION_MODELS)
    if unknown:
        raise ValueError(f"unknown attribution models: {sorted(unknown)}")
    parts = [sourced(opps)] if V.SOURCED in models else []
    touch_models = [m for m in TOUCH_MODELS if m in models]
    if touch_models:
        links = deal_links(opps, touches, accounts, window_days, half_life_days, domain_source)
        parts.append(touch_credits(channel_shares(links), touch_models))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def compare_models(results: DataFrame, models: Sequence[str] = V.ATTRIBUTION_MODELS) -> DataFrame:
    """Channels as rows, models as columns, 0 where a model gives nothing."""
    chosen = results.where(F.col("attribution_model").isin(list(models)))
    return pivot_sum(chosen, "channel", "attribution_model", "attributed_pipeline", models, other=None)


def channels_above(results: DataFrame, least: float = 1000) -> DataFrame:
    """Channels whose credits over all models add up to more than a threshold."""
    sums = results.groupBy("channel").agg(total("attributed_pipeline").alias("attributed_pipeline"))
    return sums.where(F.col("attributed_pipeline") > F.lit(least))


def attribution_rows(results: DataFrame) -> DataFrame:
    """Comparison with the short names that the JSON rows use."""
    names = {
        "ft": V.FIRST_TOUCH,
        "lt": V.LAST_TOUCH,
        "lin": V.LINEAR,
        "td": V.TIME_DECAY,
        "sourced": V.SOURCED,
        "influenced": V.INFLUENCED,
    }
    picked = (F.col(f"`{model}`").alias(name) for name, model in names.items())
    return compare_models(results).select("channel", *picked)


def model_shift(
    results: DataFrame, before: str = V.FIRST_TOUCH, after: str = V.LAST_TOUCH
) -> DataFrame:
    """Credit moved per channel between two models, missing credit as zero."""
    def credit(model: str) -> Column:
        return total(F.when(F.col("attribution_model") == model, F.col("attributed_pipeline")))

    return (
        results.where(F.col("attribution_model").isin(before, after))
        .groupBy("channel")
        .agg(credit(before).alias("before"), credit(after).alias("after"))
        .withColumn("shift", F.col("after") - F.col("before"))
    )


def best_models(results: DataFrame) -> DataFrame:
    wide = compare_models(results)
    label = S.best_model(
        F.col(f"`{V.FIRST_TOUCH}`"),
        F.col(f"`{V.LAST_TOUCH}`"),
        F.col(f"`{V.LINEAR}`"),
        F.col(f"`{V.TIME_DECAY}`"),
    )
    return wide.withColumn("best_model", label)


def sourced_versus_influenced(opps: DataFrame, results: DataFrame) -> DataFrame:
    """Sourced and influenced pipeline against the rest of all pipeline."""
    pipeline = opps.agg(total("amount").alias("value")).select(F.lit("pipeline").alias("part"), "value")
    credited = (
        results.where(F.col("attribution_model").isin(V.SOURCED, V.INFLUENCED))
        .groupBy(F.col("attribution_model").alias("part"))
        .agg(total("attributed_pipeline").alias("value"))
    )

    def part(name: str) -> Column:
        return total(F.when(F.col("part") == name, F.col("value")))

    row = pipeline.unionByName(credited).agg(
        part("pipeline").alias("total_pipeline"),
        part(V.SOURCED).alias("sourced"),
        part(V.INFLUENCED).alias("influenced"),
    )
    return row.withColumns(
        {
            "not_sourced": F.greatest(F.col("total_pipeline") - F.col("sourced"), F.lit(0.0)),
            "not_influenced": F.greatest(F.col("total_pipeline") - F.col("influenced"), F.lit(0.0)),
        }
    )


def attribution_report(results: DataFrame) -> DataFrame:
    """Results with money as text, largest credit first within a model."""
    return results.orderBy(
        "attribution_model", F.col("attributed_pipeline").desc_nulls_last(), "channel"
    ).select(
        "attribution_model",
        "channel",
        S.dollar_text("attributed_pipeline").alias("attributed_pipeline"),
        S.dollar_text("attributed_won").alias("attributed_won"),
        "deal_count",
    )
