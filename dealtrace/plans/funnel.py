"""Marketing funnel over five tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.aggregate import total


def _counts(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One aggregated row as (stage, value) rows."""
    row = df.agg(*(c.cast("double").alias(name) for name, c in counts.items()))
    return row.unpivot([], list(counts), "stage", "value")


def stage_values(
    campaign: DataFrame, ads: DataFrame, email: DataFrame, web: DataFrame, opps: DataFrame
) -> DataFrame:
    """Un-truncated value per funnel stage: each table is read once."""
    impressions, clicks, fills, mails, mail_clicks, all_, sourced, won, sourced_won = V.FUNNEL_STAGES
    marketing, is_won = S.is_true("is_marketing_sourced"), S.is_true("is_won")
    parts = [
        _counts(
            campaign,
            {impressions: total("impressions"), clicks: total("clicks"), fills: total("form_fills")},
        ),
        _counts(ads, {impressions: total("impressions"), clicks: total("clicks")}),
        _counts(web, {fills: F.count_if("is_goal_completed")}),
        _counts(email, {mails: F.count(F.lit(1)), mail_clicks: F.count_if("is_click")}),
        _counts(
            opps,
            {
                all_: F.count(F.lit(1)),
                sourced: F.count_if(marketing),
                won: F.count_if(is_won),
                sourced_won: F.count_if(marketing & is_won),
            },
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("stage").agg(F.sum("value").alias("value"))


def funnel(
    campaign: DataFrame, ads: DataFrame, email: DataFrame, web: DataFrame, opps: DataFrame
) -> DataFrame:
    """Nine stages with their conversion from the previous and the first one.

    The stages are counted over different populations, so a rate may exceed 1.
    """
    numbers = F.create_map(
        *(F.lit(x) for i, name in enumerate(V.FUNNEL_STAGES, start=1) for x in (name, i))
    )
    in_order = Window.partitionBy("channel").orderBy("stage_no")  # nine rows
    rows = stage_values(campaign, ads, email, web, opps).select(
        F.lit(V.FUNNEL_SCOPE).alias("channel"),
        F.element_at(numbers, F.col("stage")).alias("stage_no"),
        "stage",
        F.col("value").cast("bigint").alias("count"),
    )
    return rows.select(
        "*",
        S.ratio("count", F.lag("count").over(in_order)).alias("conversion_from_prev"),
        S.ratio("count", F.first("count").over(in_order)).alias("percent_of_initial"),
    )
