"""Cleaning jobs: one raw export in, one typed table out.

Every job is a single projection (plus one aggregate for the deal changelog):
no job looks at the data to decide what to do, so all of them stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.state import latest_state
from ..sources.schemas import TABLES, complete, conform


def _tidy(raw: DataFrame, table: str, add_missing: bool = True) -> DataFrame:
    """Neutral names, null tokens removed, numbers and times parsed by type."""
    df = conform(raw, table, keep_others=True, add_missing=add_missing)
    types = {f.name: f.type for f in TABLES[table].fields}
    columns = []
    for name in df.columns:
        cell = F.col(f"`{name}`")
        kind = types.get(name)
        if kind is None and table in ("opportunities", "contacts") and "date" in name.lower():
            kind = "timestamp"
        # Null tokens are neither numbers nor times; only text needs the test.
        if kind == "double":
            cell = S.number(cell)
        elif kind == "bigint":
            cell = S.zero_if_null(S.number(cell))
        elif kind == "timestamp":
            cell = S.timestamp(cell)
        else:
            cell = S.null_if_token(cell)
        columns.append(cell.alias(name))
    return df.select(*columns)


def _set(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


def clean_opportunities(
    raw: DataFrame,
    channels: Mapping[str, str] = V.LEAD_SOURCE_CHANNELS,
    marketing: Iterable[str] = V.MARKETING_CHANNELS,
    mode: str = "merge",
    tiebreak: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Deal changelog to one typed row per deal, with its channel.

    Columns that the export lacks are added after the merge, so that they are
    neither ranked nor shuffled.
    """
    log = _tidy(raw, "opportunities", add_missing=False)
    if "version" in log.columns:
        log = latest_state(log, ["opp_id"], "version", tiebreak, mode)
    flags = [c for c in ("is_won", "is_closed", "is_deleted") if c in log.columns]
    deals = complete(_set(log, {c: S.flag(c) for c in flags}), "opportunities")
    deals = _set(
        deals,
        {
            "segment": S.trimmed("segment"),
            "channel_category": S.channel_of_source("lead_source", channels),
        },
    )
    return deals.withColumn("is_marketing_sourced", S.is_marketing("channel_category", marketing))


def clean_accounts(
    raw: DataFrame,
    industries: Mapping[str, str] = V.INDUSTRY_NAMES,
    countries: Mapping[str, str] = V.COUNTRY_ALIASES,
    bands: Sequence[tuple] = V.REVENUE_BANDS,
) -> DataFrame:
    return _set(
        _tidy(raw, "accounts"),
        {
            "domain": S.domain("domain"),
            "website": S.domain("website"),
            "country": S.country("country", countries),
            "industry": S.industry("industry", industries),
            "is_qualified": S.strict_flag("is_qualified"),
            "is_top_account": S.strict_flag("is_top_account"),
            "tier": S.tier("tier"),
            "segment": S.segment_from_revenue("segment", "annual_revenue", bands),
        },
    )


def clean_campaign(raw: DataFrame, null_period: str | None = None) -> DataFrame:
    return _set(
        _tidy(raw, "campaign"),
        {
            "domain": S.domain("domain"),
            "month_year": S.month("activity_date", null_period),
            "ctr": S.click_rate("clicks", "impressions"),
            "cost_per_click": S.cost_per("spend", "clicks"),
            "cost_per_form_fill": S.cost_per("spend", "form_fills"),
        },
    )


def clean_ads(raw: DataFrame, null_period: str | None = None) -> DataFrame:
    return _set(
        _tidy(raw, "ads"),
        {
            "platform": S.trimmed("platform"),
            "ctr": S.click_rate("clicks", "impressions"),
            "cpm": S.cost_per_thousand("spend", "impressions"),
            "cpc": S.cost_per("spend", "clicks"),
            "landing_cvr": S.click_rate("pageviews", "clicks"),
            "month_year": S.month("activity_date", null_period),
        },
    )


def clean_email(
    raw: DataFrame,
    industries: Mapping[str, str] = V.INDUSTRY_NAMES,
    null_period: str | None = None,
) -> DataFrame:
    return _set(
        _tidy(raw, "email"),
        {
            "subject": S.single_line("subject"),
            "domain": S.domain("domain"),
            "industry": S.industry("industry", industries),
            "seniority": S.trimmed_or_unknown("seniority"),
            "is_click": S.engaged("engagement", V.ENGAGEMENT_CLICK),
            "is_open": S.engaged("engagement", V.ENGAGEMENT_OPEN),
            "is_register": S.engaged("engagement", V.ENGAGEMENT_REGISTER),
            "days_to_engage": S.whole_days_between("event_time", "sent_date"),
            "month_year": S.month("event_time", null_period),
        },
    )


def clean_web(raw: DataFrame, null_period: str | None = None) -> DataFrame:
    web = _set(
        _tidy(raw, "web"),
        {
            "month_year": S.month("event_time", null_period),
            "domain": S.domain("domain"),
            **S.source_flags("utm_source"),
            "is_goal_completed": S.strict_flag("is_goal_completed"),
        },
    )
    return web.withColumn("has_domain", F.col("domain").isNotNull())


def clean_contacts(
    raw: DataFrame,
    free_mail: Iterable[str] = V.FREE_MAIL_DOMAINS,
    industries: Mapping[str, str] = V.INDUSTRY_NAMES,
    stages: Mapping[str, str] = V.LIFECYCLE_STAGES,
) -> DataFrame:
    contacts = _set(
        _tidy(raw, "contacts"),
        {
            "domain": S.domain("domain"),
            "industry": S.industry("industry", industries),
            "seniority": S.trimmed_or_unknown("seniority"),
            "lifecycle_stage": S.lifecycle_stage("lifecycle_stage", stages),
        },
    )
    return contacts.where(S.not_free_mail("domain", free_mail))


def clean_segments(
    raw: DataFrame,
    industries: Mapping[str, str] = V.INDUSTRY_NAMES,
    rules: Sequence[tuple] = V.SEGMENT_KEYWORDS,
) -> DataFrame:
    return _set(
        _tidy(raw, "segments"),
        {
            "domain": S.domain("domain"),
            "industry": S.industry("industry", industries),
            "segment_category": S.segment_category("segment", rules),
        },
    )


CLEANERS = {
    "opportunities": clean_opportunities,
    "accounts": clean_accounts,
    "campaign": clean_campaign,
    "ads": clean_ads,
    "email": clean_email,
    "web": clean_web,
    "contacts": clean_contacts,
    "segments": clean_segments,
}
