"""The whole run, from raw exports to reports, stage by stage.

Each stage reads the tables of the one before from shared storage and writes
its own, so a stage can be repeated alone, plans stay short, and an executor
lost late costs no more than the stage it was lost in.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed_values as V
from ..operators.aggregate import engagement_rates
from ..sources import read_raw, read_report, read_table, write_report, write_table
from ..sources.tables import RAW_FILES
from . import account360 as accounts360
from . import advanced, attribution, channel, journey, reports, touch, winprob
from .clean import CLEANERS
from .funnel import funnel
from .quality import reconcile

# Event logs are written by month of this column.
LOG_DATES = {"campaign": "activity_date", "email": "event_time", "web": "event_time"}


def _cleaned(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{out}/cleaned", name) for name in CLEANERS}


def clean_stage(
    spark: SparkSession,
    raw: str,
    out: str,
    files: Mapping[str, str] = RAW_FILES,
    multi_line: bool = False,
) -> None:
    """Raw exports to typed tables."""
    for name, cleaner in CLEANERS.items():
        rows = cleaner(read_raw(spark, raw, name, files, multi_line=multi_line))
        write_table(rows, f"{out}/cleaned", name, LOG_DATES.get(name))


def integrate_stage(
    spark: SparkSession, out: str, platforms: Mapping[str, str] = V.PLATFORM_CHANNELS
) -> None:
    """Account table, channel table, funnel, creative table, touch log."""
    t = _cleaned(spark, out)
    made = {
        "master_account": accounts360.account360(
            t["accounts"],
            t["segments"],
            t["campaign"],
            t["email"],
            t["web"],
            t["opportunities"],
            t["contacts"],
        ),
        "channel_pipeline": channel.channel_pipeline(t["opportunities"], t["ads"], platforms),
        "funnel_metrics": funnel(t["campaign"], t["ads"], t["email"], t["web"], t["opportunities"]),
        "creative_performance": reports.creative_performance(t["ads"]),
    }
    for name, df in made.items():
        write_table(df, f"{out}/integrated", name)
    log = touch.touchpoints(t["campaign"], t["email"], t["web"])
    write_table(log, f"{out}/integrated", "touchpoints", "touch_date")


def report_stage(spark: SparkSession, out: str) -> None:
    """Channel, segment, creative, email and budget reports."""
    t = _cleaned(spark, out)
    master, channels, creative = (
        read_table(spark, f"{out}/integrated", name)
        for name in ("master_account", "channel_pipeline", "creative_performance")
    )
    scenarios = channel.budget_scenarios(channels)
    email = t["email"]
    made = {
        "channel_roi": {"channels": channel.channel_roi_report(channels)},
        "segment_conversion": {
            "by_segment": reports.segment_conversion(t["opportunities"]),
            "by_industry": accounts360.industry_pipeline(master),
            "by_seniority": reports.contacts_by_seniority_stage(t["contacts"]),
        },
        "creative_performance": {
            "top_by_click_rate": reports.top_creatives(creative),
            "by_attribute": reports.creative_by_attribute(creative),
            "by_platform": reports.creative_by_platform(creative),
        },
        "email_performance": {
            "by_campaign": reports.email_by_campaign(email),
            "by_seniority": engagement_rates(email, "seniority"),
            "by_industry": reports.email_by_industry(email),
            "by_quarter": engagement_rates(email, "quarter_segment"),
        },
        "budget": {"scenarios": scenarios, "totals": channel.budget_totals(scenarios)},
    }
    for report, tables in made.items():
        write_report(tables, f"{out}/reports", report)


def attribution_stage(spark: SparkSession, out: str) -> None:
    """Six models, written once and compared from what was written."""
    t = _cleaned(spark, out)
    log = read_table(spark, f"{out}/integrated", "touchpoints")
    results = attribution.attribution(t["opportunities"], log, t["accounts"])
    write_table(results, f"{out}/integrated", "attribution_results")
    results = read_table(spark, f"{out}/integrated", "attribution_results")
    tables = {
        "models": attribution.attribution_report(results),
        "comparison": attribution.compare_models(results),
        "shift": attribution.model_shift(results),
        "best_model": attribution.best_models(results),
    }
    write_report(tables, f"{out}/reports", "attribution_models")


def advanced_stage(
    spark: SparkSession, out: str, trees: int = V.WIN_TREES, scored: str = "open"
) -> None:
    """Win scores (of open or closed deals), coverage, velocity, journeys, qualified accounts, matrix, cohorts."""
    t = _cleaned(spark, out)
    opps, accounts = t["opportunities"], t["accounts"]
    deals = winprob.win_features(opps, read_table(spark, f"{out}/integrated", "master_account"))
    model = winprob.fit_win_model(deals, trees=trees)
    model.save(f"{out}/integrated/win_model")
    made = {
        "win_probability": winprob.score_open(model, deals, scored),
        "feature_importance": winprob.feature_importance(model, deals),
        "account_coverage": advanced.coverage(accounts, t["email"], t["campaign"], opps),
        "deal_velocity": advanced.velocity(opps),
        "journey_sequences": journey.journeys(opps, touch.touchpoints(t["campaign"], t["email"])),
        "qualified_performance": advanced.qualified_performance(opps, accounts),
        "targeting_matrix": advanced.targeting_matrix(opps, accounts),
        "cohort_analysis": advanced.cohorts(opps),
    }
    for name, df in made.items():
        write_table(df, f"{out}/integrated", name)
    covered, paths = (
        read_table(spark, f"{out}/integrated", name)
        for name in ("account_coverage", "journey_sequences")
    )
    tables = {
        "account_coverage": advanced.coverage_summary(covered),
        "journey_sequences": journey.top_sequences(paths),
        "first_channels": journey.first_channels(paths),
        "velocity_by_segment": advanced.velocity(opps, "segment").drop("p25", "p75"),
        "profile_fit": advanced.profile_fit_performance(opps, accounts),
    }
    write_report(tables, f"{out}/reports", "advanced_analytics")


def check_stage(spark: SparkSession, out: str) -> DataFrame:
    """Reconcile what was written; also written as a table."""
    t = _cleaned(spark, out)
    channels, master, stages, results = (
        read_table(spark, f"{out}/integrated", name)
        for name in ("channel_pipeline", "master_account", "funnel_metrics", "attribution_results")
    )
    checks = reconcile(
        t["opportunities"],
        channels,
        master,
        read_report(spark, f"{out}/reports", "channel_roi", "channels"),
        stages,
        results,
        t["campaign"],
        t["ads"],
        t["email"],
        t["web"],
    )
    write_table(checks, f"{out}/integrated", "checks")
    return read_table(spark, f"{out}/integrated", "checks")


def run_all(
    spark: SparkSession,
    raw: str,
    out: str,
    files: Mapping[str, str] = RAW_FILES,
    trees: int = V.WIN_TREES,
) -> DataFrame:
    """Every stage in order; returns the checks."""
    clean_stage(spark, raw, out, files)
    integrate_stage(spark, out)
    report_stage(spark, out)
    attribution_stage(spark, out)
    advanced_stage(spark, out, trees)
    return check_stage(spark, out)
