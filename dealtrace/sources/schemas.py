"""Logical tables: neutral column names, raw spellings and clean types.

``conform`` renames whatever an export calls its columns to the neutral names
and adds the missing ones as nulls, so that no later step has to ask whether a
column exists.  It looks at column names only and never at the data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    raw: tuple[str, ...] = ()
    pattern: str | None = None  # regular expression on the lower-cased name
    merge: bool = False  # several spellings may be present: first non-null wins


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    drop: tuple[str, ...] = field(default=())

    def schema(self) -> T.StructType:
        text = ", ".join(f"`{f.name}` {f.type}" for f in self.fields)
        return T._parse_datatype_string(text)


def _f(name: str, type_: str, *raw: str, pattern: str | None = None, merge: bool = False) -> Field:
    return Field(name, type_, raw, pattern, merge)


# Columns the pipeline needs and their spellings in the exports.
_ETL = ("_sdc_table_version", "_sdc_sequence")

TABLES = {
    t.name: t
    for t in (
        Table(
            "opportunities",
            (
                _f("opp_id", "string", "_opportunity_id"),
                _f("version", "double", "_order"),
                _f("account_id", "string", "_account_id"),
                _f("account_name", "string", "_account_name"),
                _f("domain", "string", "_domain"),
                _f("amount", "double", "_amount"),
                _f("acv", "double", "_acv"),
                _f("mrr", "double", "_mrr"),
                _f("max_amount", "double", "_maxamount"),
                _f("probability", "double", "_probability"),
                _f("age_days", "double", "_days"),
                _f("stage_days", "double", "_days_current_stage"),
                _f("close_days", "double", "_days_instage3_closewon"),
                _f("mrr_amount", "double", "mrr_amount__c"),
                _f("one_time_amount", "double", "total_one_time__c"),
                _f("create_date", "timestamp", pattern="createdate"),
                _f("close_date", "timestamp", "_close_date"),
                _f("is_won", "boolean", "iswon", "_iswon", merge=True),
                _f("is_closed", "boolean", "_isclosed"),
                _f("is_deleted", "boolean", "isdeleted"),
                _f("lead_source", "string", "_leadsource"),
                _f("segment", "string", "segment__c"),
                _f("stage", "string", pattern=r"^(?!.*days).*current_?stage"),
                _f("lost_reason", "string", pattern="lostreason"),
            ),
        ),
        Table(
            "accounts",
            (
                _f("account_id", "string", "accountid"),
                _f("domain", "string", "domain__c"),
                _f("website", "string", "website"),
                _f("country", "string", "billingcountry"),
                _f("industry", "string", "industry"),
                _f("annual_revenue", "double", "annualrevenue"),
                _f("employees", "double", "numberofemployees"),
                _f("intent_score", "double", "accountintentscore6sense__c"),
                _f("opportunity_count", "double", "numberofopportunities__c"),
                _f("partner_count", "double", "number_of_partners__c"),
                _f("is_qualified", "boolean", "account6qa6sense__c"),
                _f("is_top_account", "boolean", "top_5_account__c"),
                _f("created_date", "timestamp", "createddate"),
                _f("tier", "string", "tier"),
                _f("segment", "string", "segment__c"),
                _f("profile_fit", "string", "accountprofilefit6sense__c", pattern="profilefit"),
                _f("account_name", "string", "account_name", "name"),
            ),
        ),
        Table(
            "campaign",
            (
                _f("domain", "string", "_6sensedomain"),
                _f("campaign_id", "string", "_campaignid"),
                _f("spend", "double", "_spend"),
                _f("clicks", "double", "_clicks"),
                _f("impressions", "double", "_impressions"),
                _f("form_fills", "bigint", "_influencedformfills"),
                _f("activity_date", "timestamp", "_date"),
                _f("latest_impression", "timestamp", "_latestimpression"),
            ),
            drop=_ETL,
        ),
        Table(
            "ads",
            (
                _f("activity_date", "timestamp", "day"),
                _f("spend", "double", "_spend"),
                _f("clicks", "double", "_clicks"),
                _f("impressions", "double", "_impressions"),
                _f("pageviews", "double", "pageviews"),
                _f("visitors", "double", "visitors"),
                _f("reduced_pageviews", "double", "reduced_pageviews"),
                _f("reduced_visitors", "double", "reduced_visitors"),
                _f("platform", "string", "_platform"),
                _f("ad_name", "string", "_adname"),
                _f("size", "string", "_size"),
                _f("stage", "string", "_stage"),
                _f("copy_messaging", "string", "_copymessaging"),
                _f("copy_asset_type", "string", "_copyassettype"),
                _f("copy_tone", "string", "_copytone"),
                _f("cta_softness", "string", "_ctacopysofthard"),
                _f("design_color", "string", "_designcolor"),
                _f("campaign_id", "string", "_campaignid"),
            ),
            drop=("_screenshot",),
        ),
        Table(
            "email",
            (
                _f("event_time", "timestamp", "_timestamp"),
                _f("sent_date", "timestamp", "_campaignSentDate"),
                _f("domain", "string", "_domain"),
                _f("industry", "string", "_industry"),
                _f("seniority", "string", "_seniority"),
                _f("engagement", "string", "_engagement"),
                _f("campaign_id", "string", "_campaignID"),
                _f("subject", "string", "_campaign_subject"),
                _f("quarter_segment", "string", "_quater_segment"),
            ),
            drop=_ETL,
        ),
        Table(
            "web",
            (
                _f("event_time", "timestamp", "_timestamp"),
                _f("domain", "string", "_domain"),
                _f("session_views", "double", "_totalsessionviews"),
                _f("time_spent", "double", "_timespent"),
                _f("target_accounts", "double", "_target_accounts"),
                _f("utm_source", "string", "_utmsource"),
                _f("utm_campaign", "string", "_utmcampaign"),
                _f("is_goal_completed", "boolean", "_goalcompletion"),
            ),
        ),
        Table(
            "contacts",
            (
                _f("account_id", "string", "_sfdcaccountid", "_accountid", "accountid"),
                _f("domain", "string", "_domain"),
                _f("industry", "string", "_industry"),
                _f("seniority", "string", "_seniority"),
                _f("lifecycle_stage", "string", "_lifecycleStage"),
                _f("employees", "double", "_employee"),
                _f("revenue", "double", "_revenue"),
                _f("target_accounts", "double", "_target_accounts"),
                _f("target_contacts", "double", "_target_contacts"),
            ),
            drop=("_emails", *_ETL),
        ),
        Table(
            "segments",
            (
                _f("domain", "string", "_6sensedomain"),
                _f("activity_date", "timestamp", "_date"),
                _f("industry", "string", "_industry"),
                _f("segment", "string", "_segment"),
                _f("employee_range", "string", "_6senseemployeerange"),
                _f("revenue_range", "string", "_6senserevenuerange"),
            ),
            drop=("_sdc_table_version",),
        ),
    )
}


def find_column(
    columns: Sequence[str],
    candidates: Sequence[str] = (),
    pattern: str | None = None,
) -> str | None:
    """First candidate present, else the first column whose name matches."""
    by_lower = {}
    for name in columns:
        by_lower.setdefault(name.strip().lower(), name)
    for candidate in candidates:
        hit = candidate if candidate in columns else by_lower.get(candidate.lower())
        if hit is not None:
            return hit
    if pattern is not None:
        for name in columns:
            if re.search(pattern, name.lower()):
                return name
    return None


def conform(
    df: DataFrame, table: str | Table, keep_others: bool = False, add_missing: bool = True
) -> DataFrame:
    """Project a raw frame to the table's neutral column names, all as text.

    Unwanted load columns go; ``keep_others`` passes unlisted columns through.
    Columns the export lacks come as nulls unless ``add_missing`` is off.
    """
    spec = TABLES[table] if isinstance(table, str) else table
    dropped = {d.lower() for d in spec.drop}
    columns = [c for c in df.columns if c.strip().lower() not in dropped]
    chosen, used = [], set()
    for f in spec.fields:
        source = find_column(columns, (f.name, *f.raw), f.pattern)
        if f.merge:
            present = [find_column(columns, (name,)) for name in (f.name, *f.raw)]
            present = [name for name in present if name is not None]
            if not present and not add_missing:
                continue
            used.update(present)
            texts = [S.null_if_token(df[f"`{c}`"].cast("string")) for c in present]
            chosen.append(F.coalesce(*texts, F.lit(None).cast("string")).alias(f.name))
        elif source is None:
            if add_missing:
                chosen.append(F.lit(None).cast("string").alias(f.name))
        else:
            used.add(source)
            chosen.append(df[f"`{source}`"].cast("string").alias(f.name))
    if keep_others:
        chosen += [df[f"`{c}`"].alias(c.strip()) for c in columns if c not in used]
    return df.select(*chosen)


def complete(df: DataFrame, table: str | Table) -> DataFrame:
    """Typed frame with the table's missing columns added as typed nulls, first
    the table's columns in order, then the others."""
    spec = TABLES[table] if isinstance(table, str) else table
    named = [f.name for f in spec.fields]
    missing = {f.name: F.lit(None).cast(f.type) for f in spec.fields if f.name not in df.columns}
    return df.withColumns(missing).select(*named, *(c for c in df.columns if c not in named))
