"""Creative, email, segment and contact reports, and the KPI tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.aggregate import (
    ad_totals,
    count_by,
    deal_summary,
    drop_null_keys,
    engagement_rates,
    non_null_columns,
    top_n,
    total,
)
from ..operators.reshape import ranked_pivot
from ..sources.scratch import keep

# --- creative --------------------------------------------------------------


def creative_performance(
    ads: DataFrame,
    attributes: Sequence[str] = V.CREATIVE_COLUMNS,
    drop_all_null: bool = True,
) -> DataFrame:
    """Ad totals by every creative attribute, with rates.

    An attribute that is null on all rows is not a column.  The ads are read
    once: they are reduced by all attributes and written, and the few reduced
    rows tell which attributes hold a value.  Missing values are grouped as
    Unknown.
    """
    keys = [c for c in attributes if c in ads.columns]
    measures = ["spend", "clicks", "impressions", "pageviews"]
    texts = ads.withColumns({c: F.col(c).cast("string") for c in keys})
    grouped = texts.groupBy(*keys).agg(*(total(m).alias(m) for m in measures))
    if drop_all_null and keys:
        grouped = keep(grouped, "creatives")
        keys = non_null_columns(grouped, keys)
    # Without the attributes that are null everywhere the groups are the same ones.
    filled = [S.or_unknown(F.col(c)).alias(c) for c in keys]
    grouped = ad_totals(grouped.select(*filled, *measures), keys, *measures)
    if not keys:
        grouped = grouped.where(F.lit(False))
    return grouped.withColumns(
        {
            "ctr": S.click_rate("clicks", "impressions"),
            "cpm": S.cost_per_thousand("spend", "impressions"),
            "cpc": S.cost_per("spend", "clicks"),
            "landing_cvr": S.click_rate("pageviews", "clicks", 4),
        }
    )


def top_creatives(creative: DataFrame, n: int = 20) -> DataFrame:
    """Best click rates first; ties go to the larger, then the earlier name."""
    keys = [c for c in V.CREATIVE_COLUMNS if c in creative.columns]
    return top_n(creative, "ctr", n, F.col("impressions").desc(), *keys)


def creative_by_attribute(
    creative: DataFrame, attributes: Sequence[str] = V.CREATIVE_ATTRIBUTES
) -> DataFrame:
    """Ad totals by each value of each attribute, in one pass.

    The creative table is already reduced to one row per combination; it is
    unpivoted to (attribute, value) rows and reduced again before the shuffle.
    """
    present = [c for c in attributes if c in creative.columns]
    pairs = F.array(
        *(
            F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"))
            for c in present
        )
    ).cast("array<struct<attribute:string,value:string>>")
    long = creative.select(F.explode(pairs).alias("p"), "impressions", "clicks", "spend").select(
        "p.attribute", "p.value", "impressions", "clicks", "spend"
    )
    return ad_totals(long, ["attribute", "value"], "impressions", "clicks", "spend").withColumns(
        {"ctr": S.click_rate("clicks", "impressions"), "cpc": S.cost_per("spend", "clicks", 2)}
    )


def creative_by_platform(creative: DataFrame) -> DataFrame:
    if "platform" not in creative.columns:
        creative = creative.withColumn("platform", F.lit(None).cast("string"))
    return ad_totals(creative, "platform", "spend", "impressions", "clicks").withColumns(
        {
            "ctr": S.click_rate("clicks", "impressions"),
            "cpm": S.cost_per_thousand("spend", "impressions", 2),
        }
    )


# --- email -----------------------------------------------------------------


def email_by_campaign(email: DataFrame) -> DataFrame:
    """Rates per campaign with its first subject, in one shuffle."""
    counted = (
        drop_null_keys(email, "campaign_id")
        .groupBy("campaign_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if("is_open").alias("opens"),
            F.count_if("is_click").alias("clicks"),
            F.count_if("is_register").alias("registers"),
            F.min_by(
                "subject",
                F.when(F.col("subject").isNotNull(), F.struct("event_time", "subject")),
            ).alias("subject"),
        )
    )
    return counted.select(
        "*",
        S.ratio("opens", "events", 4).alias("open_rate"),
        S.ratio("clicks", "events", 4).alias("click_rate"),
        S.ratio("registers", "events", 4).alias("register_rate"),
        S.ratio("clicks", "opens", 4).alias("click_to_open"),
    )


def email_by_industry(email: DataFrame, n: int = 20) -> DataFrame:
    return top_n(engagement_rates(email, "industry"), "click_rate", n, "industry")


# --- segments, contacts, deals --------------------------------------------


def segment_conversion(opps: DataFrame) -> DataFrame:
    return deal_summary(opps, "segment", 4)


def contacts_by_seniority_stage(contacts: DataFrame) -> DataFrame:
    """Contacts by seniority and lifecycle stage, and by seniority alone.

    One pass with grouping sets; the seniority totals have a null stage and
    ``is_total`` set, and count contacts without a stage too.
    """
    rows = contacts.where(F.col("seniority").isNotNull()).select("seniority", "lifecycle_stage")
    seniority, stage = F.col("seniority"), F.col("lifecycle_stage")
    counted = rows.groupingSets([[seniority, stage], [seniority]], seniority, stage).agg(
        F.grouping("lifecycle_stage").cast("boolean").alias("is_total"),
        F.count(F.lit(1)).alias("contacts"),
    )
    return counted.where(F.col("is_total") | stage.isNotNull())


def monthly_pipeline(opps: DataFrame, null_period: str | None = None) -> DataFrame:
    dated = opps.select(S.month("create_date", null_period).alias("month"), "channel_category", "amount")
    return (
        drop_null_keys(dated, ["month", "channel_category"])
        .groupBy("month", "channel_category")
        .agg(total("amount").alias("pipeline"))
    )


def monthly_campaign(campaign: DataFrame) -> DataFrame:
    return (
        drop_null_keys(campaign, "month_year")
        .groupBy("month_year")
        .agg(total("spend").alias("spend"), total("impressions").alias("impressions"))
    )


def kpis(opps: DataFrame) -> DataFrame:
    """Headline figures in one row."""
    won, marketing = S.is_true("is_won"), S.is_true("is_marketing_sourced")
    return opps.agg(
        total("amount").alias("total_pipeline"),
        total(F.when(won, F.col("amount"))).alias("won_pipeline"),
        total(F.when(marketing, F.col("amount"))).alias("marketing_pipeline"),
        F.count(F.lit(1)).alias("deals"),
        F.count_if(won).alias("won_deals"),
    ).withColumns(
        {
            "win_rate": F.coalesce(S.win_rate("won_deals", "deals", None), F.lit(0.0)),
            "marketing_share": F.coalesce(S.ratio("marketing_pipeline", "total_pipeline"), F.lit(0.0)),
        }
    )


def campaign_kpis(campaign: DataFrame) -> DataFrame:
    return campaign.agg(
        total("spend").alias("spend"),
        total("impressions").alias("impressions"),
        total("clicks").alias("clicks"),
        total("form_fills", "bigint").alias("form_fills"),
    ).withColumns(
        {
            "ctr": F.coalesce(S.ratio("clicks", "impressions"), F.lit(0.0)),
            "cost_per_fill": F.coalesce(S.ratio("spend", "form_fills"), F.lit(0.0)),
        }
    )


def email_kpis(email: DataFrame) -> DataFrame:
    return engagement_rates(email, (), None)


def web_kpis(web: DataFrame) -> DataFrame:
    return web.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("is_goal_completed").alias("goals"),
        F.count_if("has_domain").alias("identified"),
        F.count_if("is_display_traffic").alias("display_sessions"),
    )


def traffic_mix(web: DataFrame) -> DataFrame:
    """Sessions per traffic source; what is left over is Other/Direct."""
    named = {
        "6sense Display": "is_display_traffic",
        "Email": "is_email_traffic",
        "LinkedIn": "is_social_traffic",
        "Organic": "is_organic",
    }
    row = web.agg(
        *(F.count_if(flag).alias(name) for name, flag in named.items()),
        F.count(F.lit(1)).alias("_all"),
    )
    rest = F.col("_all") - sum((F.col(f"`{name}`") for name in named), F.lit(0))
    row = row.withColumn("Other/Direct", F.greatest(rest, F.lit(0)).cast("bigint"))
    mix = row.unpivot([], [*named, "Other/Direct"], "traffic_source", "sessions")
    return mix.where(F.col("sessions") > 0)


def open_by_stage(opps: DataFrame, n: int = 10) -> DataFrame:
    open_deals = opps.where(S.is_open_deal("is_won") & F.col("amount").isNotNull())
    grouped = (
        drop_null_keys(open_deals, "stage")
        .groupBy("stage")
        .agg(F.count("stage").alias("deals"), total("amount").alias("pipeline"))
    )
    return top_n(grouped, "pipeline", n, "stage")


def pipeline_by_segment(opps: DataFrame) -> DataFrame:
    rows = opps.na.drop(subset=["segment", "amount"])
    return rows.groupBy("segment").agg(total("amount").alias("pipeline"))


def lost_reasons(opps: DataFrame, n: int = 5) -> DataFrame:
    return top_n(count_by(opps, "lost_reason", "deals"), "deals", n, "lost_reason")


def industry_segment_matrix(
    master: DataFrame, segments: Sequence[str] | None = None, n: int = 12
) -> DataFrame:
    """Pipeline by industry and segment, the ``n`` industries with most of it."""
    known = master.na.drop(subset=["industry", "segment"])
    return ranked_pivot(known, "industry", "segment", "total_pipeline", segments, n)


def fit_distribution(accounts: DataFrame) -> DataFrame:
    return count_by(accounts, "profile_fit", "accounts")
