"""Coverage, velocity, qualified accounts, targeting matrix, cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.aggregate import (
    deal_summary,
    drop_null_keys,
    pre_aggregate_deals,
    summarise_totals,
)
from ..operators.membership import marks as marked
from ..operators.reshape import pivot_sum

# --- coverage --------------------------------------------------------------


def coverage(
    accounts: DataFrame, email: DataFrame, campaign: DataFrame, opps: DataFrame
) -> DataFrame:
    """Which account domains were reached, by which source, and have a deal.

    Membership in three sets is one grouped OR over the stacked domains: one
    shuffle, reduced per task, instead of three distinct sets and three joins.
    """
    marks = {"is_account": accounts, "in_email": email, "in_display": campaign, "has_opportunity": opps}
    stacked = None
    for mark, df in marks.items():
        rows = df.where(F.col("domain").isNotNull()).select(
            S.join_key("domain").alias("domain"), F.lit(True).alias(mark)
        )
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    grouped = stacked.groupBy("domain").agg(
        *(F.coalesce(F.bool_or(mark), F.lit(False)).alias(mark) for mark in marks)
    )
    return grouped.where("is_account").select(
        "domain",
        "in_email",
        "in_display",
        "has_opportunity",
        (F.col("in_email").cast("int") + F.col("in_display").cast("int"))
        .cast("bigint")
        .alias("reached_count"),
        S.coverage_tier("in_email", "in_display").alias("coverage_tier"),
    )


def coverage_by_marks(
    accounts: DataFrame, email: DataFrame, campaign: DataFrame, opps: DataFrame
) -> DataFrame:
    """The rows of :func:`coverage`, the four memberships kept as bits of one number."""
    frames = {"is_account": accounts, "in_email": email, "in_display": campaign, "has_opportunity": opps}
    keyed = {mark: df.select(S.join_key("domain").alias("domain")) for mark, df in frames.items()}
    return marked(keyed, "domain").where("is_account").select(
        "domain",
        "in_email",
        "in_display",
        "has_opportunity",
        (F.col("in_email").cast("int") + F.col("in_display").cast("int")).cast("bigint").alias("reached_count"),
        S.coverage_tier("in_email", "in_display").alias("coverage_tier"),
    )


def coverage_summary(covered: DataFrame, tiers: Sequence[str] = V.COVERAGE_TIERS) -> DataFrame:
    """Accounts, share and deal rate per tier, in the tiers' own order."""
    numbers = F.create_map(*(F.lit(x) for i, t in enumerate(tiers, start=1) for x in (t, i)))
    whole = Window.partitionBy(F.lit(1))  # over at most four rows
    return (
        covered.groupBy("coverage_tier")
        .agg(
            F.count("domain").alias("accounts"),
            F.count_if("has_opportunity").alias("with_opp"),
        )
        .select(
            F.element_at(numbers, F.col("coverage_tier")).alias("tier_no"),
            "coverage_tier",
            "accounts",
            "with_opp",
            S.ratio("accounts", F.sum("accounts").over(whole)).alias("pct_of_total"),
            S.ratio("with_opp", "accounts").alias("opp_rate"),
        )
        .orderBy("tier_no")
    )


# --- velocity --------------------------------------------------------------


def velocity(
    opps: DataFrame,
    by: str = "channel_category",
    lo: int = V.VELOCITY_DAYS[0],
    hi: int = V.VELOCITY_DAYS[1],
) -> DataFrame:
    """Days from create to close of won deals: mean, median and quartiles.

    Percentiles are exact. Days are whole and bounded by ``hi``, so a group
    keeps at most that many distinct values however many deals it has.
    """
    timed = opps.where(S.is_true("is_won")).select(
        by, S.whole_days_between("close_date", "create_date").alias("days_to_close")
    )
    timed = drop_null_keys(timed, by).where(F.col("days_to_close").between(lo, hi))
    return timed.groupBy(by).agg(
        F.avg("days_to_close").alias("mean_days"),
        F.percentile("days_to_close", 0.5).alias("median_days"),
        F.count(F.lit(1)).alias("deal_count"),
        F.percentile("days_to_close", 0.25).alias("p25"),
        F.percentile("days_to_close", 0.75).alias("p75"),
    )


# --- qualified accounts, profile fit, targeting ---------------------------


def _totals_with(opps: DataFrame, accounts: DataFrame, column: str, *own: str) -> DataFrame:
    """Deal totals by the account's ``column``, joined after pre-aggregation."""
    keyed = opps.where(F.col("account_id").isNotNull())
    per_account = pre_aggregate_deals(keyed, ["account_id", *own])
    return per_account.join(accounts.select("account_id", column), "account_id")


def qualified_performance(opps: DataFrame, accounts: DataFrame) -> DataFrame:
    """Deals of qualified and other accounts; unknown accounts are left out."""
    return summarise_totals(_totals_with(opps, accounts, "is_qualified"), "is_qualified")


def profile_fit_performance(opps: DataFrame, accounts: DataFrame) -> DataFrame:
    totals = summarise_totals(_totals_with(opps, accounts, "profile_fit"), "profile_fit")
    return totals.drop("won_pipeline")


def targeting_matrix(opps: DataFrame, accounts: DataFrame) -> DataFrame:
    """Segment x profile fit: deals, win rate, average and priority score."""
    joined = _totals_with(opps, accounts, "profile_fit", "segment")
    return (
        summarise_totals(joined, ["segment", "profile_fit"])
        .drop("won_pipeline")
        .withColumn("priority_score", S.priority_score("win_rate", "avg_deal"))
    )


def targeting_pivot(matrix: DataFrame, fits: Sequence[str] | None = None) -> DataFrame:
    return pivot_sum(matrix, "segment", "profile_fit", "win_rate", fits, how="avg")


# --- cohorts ---------------------------------------------------------------


def cohorts(opps: DataFrame, null_period: str | None = None) -> DataFrame:
    """Deals by the quarter they were created in, amount known."""
    dated = opps.where(F.col("amount").isNotNull()).withColumn(
        "quarter", S.quarter("create_date", null_period)
    )
    sourced = (
        drop_null_keys(dated, "quarter")
        .groupBy("quarter")
        .agg(
            F.count("opp_id").alias("deals"),
            F.count_if(S.is_true("is_won")).alias("won"),
            F.sum("amount").alias("pipeline"),
            F.coalesce(F.sum(F.when(S.is_true("is_won"), F.col("amount"))), F.lit(0.0)).alias(
                "won_pipeline"
            ),
            F.avg("amount").alias("avg_deal"),
            F.count_if(S.is_true("is_marketing_sourced")).alias("marketing_sourced"),
        )
    )
    return sourced.withColumns(
        {
            "win_rate": S.win_rate("won", "deals", None),
            "marketing_share": S.ratio("marketing_sourced", "deals"),
        }
    )


__all__ = [
    "cohorts",
    "coverage",
    "coverage_summary",
    "deal_summary",
    "profile_fit_performance",
    "qualified_performance",
    "targeting_matrix",
    "targeting_pivot",
    "velocity",
]
