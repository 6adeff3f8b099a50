"""Account table: one row per account with everything known about it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.aggregate import total
from ..operators.lookup import lookup_join


def domain_facts(
    segments: DataFrame, campaign: DataFrame, email: DataFrame, web: DataFrame
) -> DataFrame:
    """Segment, campaign, email and web totals per domain, in one shuffle.

    The four sources are stacked and grouped once.  Email is first reduced to
    one row per (domain, campaign), which both counts campaigns exactly and
    splits a domain that receives most of the mail.
    """
    undated = F.col("activity_date").isNull()
    order = F.struct(undated, "activity_date", "segment", "employee_range", "revenue_range")
    segment_rows = segments.select(
        "domain",
        F.lit("segments").alias("source"),
        F.col("segment").alias("segment_name"),
        "segment_category",
        F.col("employee_range").alias("emp_range"),
        F.col("revenue_range").alias("rev_range"),
        order.alias("seen"),
    )
    campaign_rows = campaign.select(
        "domain",
        F.lit("campaign").alias("source"),
        "spend",
        "clicks",
        "impressions",
        "form_fills",
    )
    email_rows = (
        email.where(F.col("domain").isNotNull())
        .groupBy("domain", "campaign_id")
        .agg(
            F.count_if("is_open").alias("opens"),
            F.count_if("is_click").alias("mail_clicks"),
            F.count_if("is_register").alias("registers"),
        )
        .withColumn("source", F.lit("email"))
    )
    web_rows = web.select(
        "domain",
        F.lit("web").alias("source"),
        "session_views",
        S.is_true("is_goal_completed").cast("bigint").alias("goals"),
    )
    stacked = segment_rows
    for rows in (campaign_rows, email_rows, web_rows):
        stacked = stacked.unionByName(rows, allowMissingColumns=True)

    def of(source: str):
        return F.col("source") == source

    def first_seen(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seen"))).alias(c)

    def within(source: str, column: str, to: str, name: str):
        return F.when(F.count_if(of(source)) > 0, total(column, to)).alias(name)

    return (
        stacked.where(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(
            F.when(F.count_if(of("segments")) > 0, F.array_sort(F.collect_set("segment_name"))).alias(
                "segment_list"
            ),
            first_seen("segment_category"),
            first_seen("emp_range"),
            first_seen("rev_range"),
            within("campaign", "spend", "double", "campaign_spend"),
            within("campaign", "clicks", "double", "campaign_clicks"),
            within("campaign", "impressions", "double", "campaign_impressions"),
            within("campaign", "form_fills", "bigint", "campaign_form_fills"),
            within("email", "opens", "bigint", "email_opens"),
            within("email", "mail_clicks", "bigint", "email_clicks"),
            within("email", "registers", "bigint", "email_registers"),
            F.when(F.count_if(of("email")) > 0, F.count("campaign_id")).alias("unique_email_campaigns"),
            F.when(F.count_if(of("web")) > 0, F.count_if(of("web"))).alias("web_sessions"),
            within("web", "session_views", "double", "web_pageviews"),
            within("web", "goals", "bigint", "web_goal_completions"),
        )
    )


def account_facts(
    opps: DataFrame,
    contacts: DataFrame,
    levels: Mapping[str, str] = V.SENIORITY_LEVELS,
) -> DataFrame:
    """Deal and contact totals per account id, in one shuffle."""
    deal_rows = opps.select(
        "account_id",
        "opp_id",
        "amount",
        S.is_true("is_won").alias("won"),
        "lead_source",
        "channel_category",
        S.is_true("is_marketing_sourced").alias("marketing"),
        F.col("account_name").alias("deal_account_name"),
    )
    contact_rows = contacts.select(
        "account_id", F.lit(True).alias("is_contact"), F.lower("seniority").alias("level")
    )

    def first_of(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("opp_id")))

    has_deals = F.count("opp_id") > 0
    has_contacts = F.count("is_contact") > 0
    return (
        deal_rows.unionByName(contact_rows, allowMissingColumns=True)
        .where(F.col("account_id").isNotNull())
        .groupBy("account_id")
        .agg(
            F.when(has_deals, total("amount")).alias("total_pipeline"),
            F.when(has_deals, total(F.when(F.col("won"), F.col("amount")))).alias("total_won"),
            F.when(has_deals, F.count("opp_id")).alias("deal_count"),
            first_of("lead_source").alias("primary_leadsource"),
            first_of("channel_category").alias("channel_category"),
            F.bool_or("marketing").alias("is_marketing_sourced"),
            first_of("deal_account_name").alias("deal_account_name"),
            F.when(has_contacts, F.count("is_contact")).alias("contact_count"),
            *(
                F.when(has_contacts, F.count_if(F.col("level") == level)).alias(name)
                for name, level in levels.items()
            ),
        )
    )


def account360(
    accounts: DataFrame,
    segments: DataFrame,
    campaign: DataFrame,
    email: DataFrame,
    web: DataFrame,
    opps: DataFrame,
    contacts: DataFrame,
) -> DataFrame:
    """Accounts with domain facts and account facts; orphan accounts appended.

    Two joins in all.  Accounts sharing a domain carry the same domain totals,
    so those columns must not be summed over accounts.  The outer join on the
    account id keeps the accounts known only from deals; both its sides have
    one row per account.
    """
    named = accounts if "account_name" in accounts.columns else accounts.withColumn(
        "account_name", F.lit(None).cast("string")
    )
    facts = domain_facts(segments, campaign, email, web)
    base = lookup_join(named, facts, "domain", spread="account_id")
    return with_account_facts(base, account_facts(opps, contacts))


def with_account_facts(base: DataFrame, by_account: DataFrame) -> DataFrame:
    """Accounts with their deal and contact totals, and the accounts known only from deals."""
    listed = F.coalesce("_listed", F.lit(False))
    return (
        base.withColumn("_listed", F.lit(True))
        .join(by_account, "account_id", "full")
        .where(listed | F.col("deal_count").isNotNull())
        .withColumn("account_name", F.when(listed, F.col("account_name")).otherwise(F.col("deal_account_name")))
        .drop("_listed", "deal_account_name")
    )


def orphan_accounts(accounts: DataFrame, opps: DataFrame) -> DataFrame:
    """Account ids found on deals but not in the account table, with a name."""
    keyed = opps.where(F.col("account_id").isNotNull())
    totals = keyed.groupBy("account_id").agg(
        total("amount").alias("total_pipeline"),
        F.count("opp_id").alias("deal_count"),
        F.min_by("account_name", F.when(F.col("account_name").isNotNull(), F.col("opp_id"))).alias(
            "account_name"
        ),
    )
    return totals.join(accounts.select("account_id"), "account_id", "left_anti")


def industry_pipeline(master: DataFrame, n: int = 20) -> DataFrame:
    """Accounts and pipeline by industry, largest first."""
    return (
        master.where(F.col("industry").isNotNull())
        .groupBy("industry")
        .agg(F.count("account_id").alias("accounts"), total("total_pipeline").alias("pipeline"))
        .orderBy(F.col("pipeline").desc_nulls_last(), "industry")
        .limit(n)
    )
