"""Channel pipeline, return on spend, and budget scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.aggregate import deal_summary, drop_null_keys, total


def channel_summary(opps: DataFrame) -> DataFrame:
    """Deals, pipeline, wins and share of all pipeline per channel."""
    grouped = deal_summary(opps, "channel_category", 4)
    whole = Window.partitionBy(F.lit(1))  # over a handful of channel rows
    return grouped.select(
        "channel_category",
        F.col("deals").alias("deal_count"),
        F.col("pipeline").alias("total_pipeline"),
        F.col("avg_deal").alias("avg_deal_size"),
        F.col("won").alias("won_count"),
        F.col("won_pipeline"),
        "win_rate",
        S.ratio("pipeline", F.sum("pipeline").over(whole), 4).alias("pipeline_pct"),
    )


def spend_by_platform(ads: DataFrame) -> DataFrame:
    return drop_null_keys(ads, "platform").groupBy("platform").agg(total("spend").alias("spend"))


def channel_pipeline(
    opps: DataFrame,
    ads: DataFrame,
    platforms: Mapping[str, str] = V.PLATFORM_CHANNELS,
) -> DataFrame:
    """Channel summary with ad spend and returns.

    Deals and ads are each reduced to one row per channel before they meet.
    """
    spend = (
        ads.where(F.col("platform").isin(list(platforms)))
        .groupBy(S.lookup("platform", platforms).alias("channel_category"))
        .agg(total("spend").alias("channel_spend"))
    )
    joined = channel_summary(opps).join(spend, "channel_category", "left")
    joined = joined.withColumn("channel_spend", F.coalesce("channel_spend", F.lit(0.0)))
    return joined.withColumns(
        {
            "pipeline_roi": S.positive_ratio("total_pipeline", "channel_spend"),
            "revenue_roi": S.positive_ratio("won_pipeline", "channel_spend"),
            "cost_per_opp": S.positive_ratio("channel_spend", "deal_count"),
        }
    )


def channel_rows(channels: DataFrame) -> DataFrame:
    """Channel table for JSON rows: missing figures are 0, missing returns null."""
    figures = ["total_pipeline", "won_pipeline", "win_rate", "avg_deal_size", "channel_spend"]
    filled = channels.na.fill(0, subset=["deal_count", *figures])
    return filled.select("channel_category", "deal_count", *figures, "pipeline_roi", "revenue_roi")


def channel_roi_report(channels: DataFrame) -> DataFrame:
    """Channel table as a report: largest pipeline first, rates as text."""
    return channels.orderBy(F.col("total_pipeline").desc_nulls_last(), "channel_category").select(
        F.col("channel_category").alias("channel"),
        F.col("deal_count").alias("deals"),
        "total_pipeline",
        F.col("won_pipeline").alias("won_revenue"),
        F.col("won_count").alias("won_deals"),
        S.percent_text("win_rate").alias("win_rate"),
        "avg_deal_size",
        S.percent_text("pipeline_pct").alias("pipeline_share"),
        "channel_spend",
        "pipeline_roi",
        "revenue_roi",
        "cost_per_opp",
        S.compact_money("total_pipeline").alias("pipeline_text"),
        S.multiple_text("pipeline_roi").alias("roi_text"),
        S.roi_band("pipeline_roi").alias("roi_band"),
    )


def budget_scenarios(
    channels: DataFrame,
    up: float = V.BUDGET_UP,
    down: float = V.BUDGET_DOWN,
    growth: float = V.BUDGET_GROWTH,
    cut: float = V.BUDGET_CUT,
    growth_channels: Sequence[str] = V.GROWTH_CHANNELS,
    n: int = V.BUDGET_RANKED,
    overlap: str = "compound",
) -> DataFrame:
    """Spend and projected pipeline per channel under three scenarios.

    Channels with spend are ranked by pipeline return.  A channel that is both
    in the top and the bottom ``n`` gets both factors (``compound``) or only
    the raise (``exclusive``).
    """
    if overlap not in ("compound", "exclusive"):
        raise ValueError(f"overlap must be 'compound' or 'exclusive', not {overlap!r}")
    spending = channels.where(F.col("channel_spend") > 0)
    whole = Window.partitionBy(F.lit(1))  # over a handful of channel rows
    best = whole.orderBy(F.col("pipeline_roi").desc_nulls_last(), "channel_category")
    worst = whole.orderBy(F.col("pipeline_roi").asc_nulls_first(), F.col("channel_category").desc())
    is_top = F.row_number().over(best) <= n
    is_bottom = F.row_number().over(worst) <= n
    ranked = spending.select(
        "channel_category",
        "channel_spend",
        S.ratio("total_pipeline", "channel_spend").alias("pipeline_per_dollar"),
        (F.col("channel_spend") / F.sum("channel_spend").over(whole)).alias("spend_share"),
        is_top.alias("is_top"),
        is_bottom.alias("is_bottom"),
    )
    grows = F.col("channel_category").isin(list(growth_channels))
    lowered = F.col("is_bottom") if overlap == "compound" else F.col("is_bottom") & ~F.col("is_top")
    halved = F.col("is_bottom") if overlap == "compound" else F.col("is_bottom") & ~grows

    def factor(condition, value: float):
        return F.when(condition, F.lit(value)).otherwise(F.lit(1.0))

    factors = [
        F.lit(1.0),
        factor(F.col("is_top"), up) * factor(lowered, down),
        factor(grows, growth) * factor(halved, cut),
    ]
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("scenario_no"),
                F.lit(name).alias("scenario"),
                (F.col("channel_spend") * f).alias("spend"),
            )
            for i, (name, f) in enumerate(zip(V.SCENARIOS, factors), start=1)
        )
    )
    return (
        ranked.withColumn("s", F.explode(rows))
        .select(
            "s.scenario_no",
            "s.scenario",
            "channel_category",
            F.col("channel_spend").alias("current_spend"),
            "spend_share",
            F.col("s.spend").alias("spend"),
            "pipeline_per_dollar",
        )
        .withColumn("projected_pipeline", F.col("spend") * F.coalesce("pipeline_per_dollar", F.lit(0.0)))
        .withColumn("change", S.change_ratio("spend", "current_spend"))
    )


def winning_channels(channels: DataFrame, least: float = 0) -> DataFrame:
    """Channels whose won pipeline is above a threshold, with the win rate as a percent number."""
    chosen = channels.where(F.col("won_pipeline") > F.lit(least))
    return chosen.withColumn("win_percent", S.percent_or_zero("win_rate"))


def budget_totals(scenarios: DataFrame) -> DataFrame:
    """Spend and pipeline per scenario and the gain over the first one."""
    whole = Window.partitionBy(F.lit(1)).orderBy("scenario_no")  # three rows
    return (
        scenarios.groupBy("scenario_no", "scenario")
        .agg(total("spend").alias("spend"), total("projected_pipeline").alias("projected_pipeline"))
        .withColumn("gain", F.col("projected_pipeline") - F.first("projected_pipeline").over(whole))
    )
