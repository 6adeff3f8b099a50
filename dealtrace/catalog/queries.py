"""Registered queries: name -> callable(spark, folder) -> DataFrame.

Every query reads the given tables through the bindings, whole.  Money is
rounded to cents and free ratios to six digits so that the order in which a
cluster adds doubles does not show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators import (
    StateStore,
    count_by,
    deal_summary,
    dictionary,
    engagement_rates,
    having,
    last_n,
    latest_state,
    listed,
    memberships,
    merged,
)
from ..plans import account360 as A
from ..plans import advanced as X
from ..plans import attribution as M
from ..plans import channel as C
from ..plans import clean as L
from ..plans import journey as J
from ..plans import reports as R
from ..plans import touch as T
from ..plans import winprob as W
from ..plans.funnel import funnel
from ..plans.quality import UNIQUE, distinct_deals, keep_all_measured, keep_measured, reconcile_totals
from ..plans.stored_master import MasterStore
from ..sources import (
    TABLES,
    cell_counts,
    line_counts,
    read_checked,
    read_raw,
    read_report,
    read_table,
    read_table_or_empty,
    rows_as_json,
    write_report,
    write_table,
)
from ..sources.scratch import keep, shared_folder
from . import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables(SimpleNamespace):
    """Lazy access to bound tables: ``t.opps``, ``t.email``, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        # Times are UTC instants; a session left in local time would shift them.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        super().__init__(spark=spark, folder=folder)

    def __getattr__(self, name: str) -> DataFrame:
        if name in B.ALL:
            return B.bound(self.spark, self.folder, name)
        raise AttributeError(name)

    def given(self, name: str) -> DataFrame:
        return B.given(self.spark, self.folder, name)


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def micros(c: str):
    return F.unix_micros(c).alias(c)


# --- changelog, cleaning ---------------------------------------------------


def _changelog(t: Tables) -> DataFrame:
    return t.given("lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.nullif("l_linenumber", F.lit(7)).alias("version"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_quantity") < 45, F.col("l_extendedprice")).alias("amount"),
        F.col("l_linestatus").alias("stage"),
        (F.col("l_partkey") * 100_000_000 + F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("row_key"),
    )


# One number for each row, so that ranks stay narrow.
TIES = ["row_key"]


@query
def latest_state_merge(t):
    last = latest_state(_changelog(t), ["id"], "version", TIES)
    return last.select("id", "version", "flag", "amount", "stage")


@query
def latest_state_row(t):
    last = latest_state(_changelog(t), ["id"], "version", TIES, mode="row")
    return last.select("id", "version", "flag", "amount", "stage")


@query
def latest_state_incremental(t):
    """The log in three batches, applied one after another to a stored state; later versions come first."""
    store = StateStore(f"{shared_folder(t.spark)}/state-{uuid.uuid4().hex}", ["id"], "version", TIES, buckets=16)
    log = _changelog(t)
    late = F.coalesce(F.col("version") > 3, F.lit(False))
    for batch in (log.where(late), log.where(~late & F.col("version").isNotNull()), log.where("version IS NULL")):
        store.apply(batch)
    return store.read(t.spark).select("id", "version", "flag", "amount", "stage")


@query
def clean_opportunities(t):
    row_key = F.col("row_key").cast("bigint")
    deals = L.clean_opportunities(t.raw_opportunities, tiebreak=[row_key])
    return deals.select(
        "opp_id",
        "version",
        "amount",
        micros("create_date"),
        "is_won",
        "lead_source",
        "channel_category",
        "is_marketing_sourced",
        "segment",
        "stage",
    )


@query
def clean_accounts(t):
    return L.clean_accounts(t.raw_accounts).select(
        "account_id",
        "domain",
        "country",
        "industry",
        F.round("annual_revenue", 2).alias("annual_revenue"),
        "is_qualified",
        "tier",
        "segment",
    )


@query
def clean_campaign(t):
    return L.clean_campaign(t.raw_campaign).select(
        "domain",
        "campaign_id",
        "spend",
        "clicks",
        "impressions",
        "form_fills",
        micros("activity_date"),
        micros("latest_impression"),
        "month_year",
        "ctr",
        "cost_per_click",
        "cost_per_form_fill",
    )


@query
def clean_ads(t):
    return L.clean_ads(t.raw_ads).select(
        micros("activity_date"),
        "spend",
        "clicks",
        "impressions",
        "pageviews",
        "platform",
        "ctr",
        "cpm",
        "cpc",
        "landing_cvr",
        "month_year",
    )


@query
def clean_email(t):
    return L.clean_email(t.raw_email).select(
        micros("event_time"),
        "domain",
        "industry",
        "seniority",
        "campaign_id",
        "subject",
        "is_click",
        "is_open",
        "is_register",
        "days_to_engage",
        "month_year",
    )


@query
def clean_web(t):
    return L.clean_web(t.raw_web).select(
        micros("event_time"),
        "domain",
        "session_views",
        "is_display_traffic",
        "is_email_traffic",
        "is_social_traffic",
        "is_organic",
        "is_goal_completed",
        "has_domain",
        "month_year",
    )


@query
def clean_contacts(t):
    return L.clean_contacts(t.raw_contacts).select(
        "account_id", "domain", "seniority", "lifecycle_stage", "employees"
    )


@query
def clean_segments(t):
    return L.clean_segments(t.raw_segments).select(
        "domain", micros("activity_date"), "segment", "segment_category", "employee_range"
    )


@query
def normalize_domain(t):
    pages = t.given("pages").select("page_id", S.domain("url").alias("domain"))
    return pages.where(S.not_free_mail("domain"))


@query
def clean_text(t):
    return t.given("documents").select(
        "doc_id",
        F.md5(S.single_line("text")).alias("text_hash"),
        F.length(S.single_line("text")).cast("bigint").alias("text_length"),
        S.segment_category("text", [("The", ["the "]), ("Und", ["und "])]).alias("category"),
    )


# --- integration -----------------------------------------------------------


def _master(t: Tables) -> DataFrame:
    return A.account360(t.accounts, t.segments, t.campaign, t.email, t.web, t.opps, t.contacts)


def _channels(t: Tables) -> DataFrame:
    return C.channel_pipeline(t.opps, t.ads, B.PLATFORMS)


def _wide(master: DataFrame) -> DataFrame:
    wide = master.withColumn("segment_list", F.array_join("segment_list", "|"))
    columns = [
        "account_id",
        "account_name",
        "domain",
        "segment_list",
        "segment_category",
        "emp_range",
        "rev_range",
        "campaign_spend",
        "campaign_clicks",
        "campaign_impressions",
        "campaign_form_fills",
        "email_opens",
        "email_clicks",
        "email_registers",
        "unique_email_campaigns",
        "web_sessions",
        "web_pageviews",
        "web_goal_completions",
        "total_pipeline",
        "total_won",
        "deal_count",
        "primary_leadsource",
        "channel_category",
        "is_marketing_sourced",
        "contact_count",
        *V.SENIORITY_LEVELS,
    ]
    return rounded(wide.select(*columns), 2, "campaign_spend", "total_pipeline", "total_won")


@query
def account360(t):
    return _wide(_master(t))


@query
def account360_stored(t):
    """From bucketed tables: all months of events but the last ones first, then these."""
    store = MasterStore(f"{shared_folder(t.spark)}/master-{uuid.uuid4().hex}", buckets=16)
    events = (t.segments, t.campaign, t.email, t.web)
    times = ("activity_date", "activity_date", "event_time", "event_time")
    last = t.campaign.agg(F.max(S.month("activity_date"))).first()[0] or ""
    late = [F.coalesce(S.month(time) >= last, F.lit(False)) for time in times]
    store.write_months(*(df.where(~x) for df, x in zip(events, late)))
    months = store.write_months(*(df.where(x) for df, x in zip(events, late)))
    store.write_accounts(t.accounts, t.opps, t.contacts, months)
    return _wide(store.read(t.spark))


@query
def orphan_accounts(t):
    return rounded(A.orphan_accounts(t.accounts, t.opps), 2, "total_pipeline")


@query
def channel_pipeline(t):
    table = rounded(_channels(t), 2, "total_pipeline", "avg_deal_size", "won_pipeline")
    return rounded(table, 4, "channel_spend")


@query
def spend_by_platform(t):
    return rounded(C.spend_by_platform(t.ads), 4, "spend")


@query
def channel_roi_report(t):
    report = C.channel_roi_report(_channels(t))
    report = rounded(report, 2, "total_pipeline", "won_revenue", "avg_deal_size")
    return rounded(report, 4, "channel_spend")


@query
def funnel_metrics(t):
    rows = funnel(t.campaign, t.ads, t.email, t.web, t.opps)
    rows = rows.withColumn("stage_no", F.col("stage_no").cast("bigint"))
    return rounded(rows, 6, "conversion_from_prev", "percent_of_initial")


def _creative(t: Tables) -> DataFrame:
    return R.creative_performance(t.ads)


@query
def creative_performance(t):
    return rounded(_creative(t), 4, "spend")


@query
def top_creatives(t):
    return rounded(R.top_creatives(_creative(t)), 4, "spend")


@query
def creative_by_attribute(t):
    return rounded(R.creative_by_attribute(_creative(t)), 4, "spend")


@query
def creative_by_platform(t):
    return rounded(R.creative_by_platform(_creative(t)), 4, "spend")


@query
def creative_labels(t):
    """Short and readable names of creatives and attributes."""
    long = R.creative_by_attribute(_creative(t))
    label, short = S.attribute_label("attribute"), S.prefix("value", 7)
    return rounded(long.select("attribute", "value", label.alias("label"), short.alias("short"), "spend"), 4, "spend")


# --- reports ---------------------------------------------------------------


@query
def segment_conversion(t):
    return rounded(R.segment_conversion(t.opps), 2, "pipeline", "won_pipeline", "avg_deal")


@query
def industry_pipeline(t):
    return rounded(A.industry_pipeline(_master(t)), 2, "pipeline")


@query
def contacts_seniority_stage(t):
    return R.contacts_by_seniority_stage(t.contacts)


@query
def email_by_campaign(t):
    return R.email_by_campaign(t.email)


@query
def email_by_seniority(t):
    return engagement_rates(t.email, "seniority")


@query
def email_by_industry(t):
    return R.email_by_industry(t.email)


@query
def email_by_quarter(t):
    return engagement_rates(t.email, "quarter_segment")


def _scenarios(t: Tables) -> DataFrame:
    return C.budget_scenarios(_channels(t))


@query
def budget_scenarios(t):
    rows = _scenarios(t).withColumn("scenario_no", F.col("scenario_no").cast("bigint"))
    rows = rounded(rounded(rows, 4, "current_spend", "spend"), 2, "projected_pipeline")
    return rounded(rows, 6, "spend_share", "pipeline_per_dollar", "change")


@query
def budget_totals(t):
    rows = C.budget_totals(_scenarios(t))
    rows = rows.withColumn("scenario_no", F.col("scenario_no").cast("bigint"))
    return rounded(rows, 2, "spend", "projected_pipeline", "gain")


# --- touches and attribution -----------------------------------------------


def _touches(t: Tables) -> DataFrame:
    return T.touchpoints(t.campaign, t.email, t.web)


def _attribution(t: Tables, *models: str) -> DataFrame:
    return M.attribution(
        t.deals,
        _touches(t),
        t.accounts,
        models or V.ATTRIBUTION_MODELS,
        window_days=B.WINDOW_DAYS,
        half_life_days=B.HALF_LIFE,
    )


def _credits(t: Tables, *models: str) -> DataFrame:
    return rounded(_attribution(t, *models), 4, "attributed_pipeline", "attributed_won")


@query
def touchpoints(t):
    return _touches(t).withColumn("touch_date", F.unix_micros("touch_date"))


@query
def touch_summary(t):
    rows = T.touch_summary(_touches(t))
    return rows.select("channel", "touch_type", "touches", "domains", micros("first_touch"), micros("last_touch"))


@query
def touch_intervals(t):
    """Every linkable deal's interval of its domain's numbered touches."""
    deals = T.linked_intervals(t.deals, _touches(t), t.accounts, B.WINDOW_DAYS).deals
    size = (F.col("after") - F.col("first")).alias("touches")
    return deals.select("opp_id", "domain", micros("create_date"), "first", "after", size)


@query
def numbered_touches(t):
    """Per domain: how many touches are numbered, and whether the numbers follow the dates without a gap."""
    touches = T.linked_intervals(t.deals, _touches(t), t.accounts, B.WINDOW_DAYS).touches
    return touches.groupBy("domain").agg(
        F.count("*").alias("touches"),
        F.min("place").alias("lowest"),
        F.max("place").alias("highest"),
        F.min_by(F.unix_micros("touch_date"), "place").alias("first_us"),
        F.max_by(F.unix_micros("touch_date"), "place").alias("last_us"),
    )


@query
def linked_touches(t):
    linked = T.linked_touches(t.deals, _touches(t), t.accounts, B.WINDOW_DAYS)
    return linked.select(
        "opp_id",
        "domain",
        micros("create_date"),
        "amount",
        "channel_category",
        "is_marketing_sourced",
        "is_won",
        micros("touch_date"),
        "channel",
        "touch_type",
        "campaign_id",
        F.round("days_before", 6).alias("days_before"),
    )


@query
def deal_channel_links(t):
    links = T.deal_links(t.deals, _touches(t), t.accounts, B.WINDOW_DAYS, B.HALF_LIFE)
    return links.select(
        "opp_id", "channel", "touches", "first_us", "last_us", F.round("weight", 6).alias("weight")
    )


@query
def deal_touch_links(t):
    links = T.link_summary(t.deals, _touches(t), t.accounts, B.WINDOW_DAYS, B.HALF_LIFE)
    return links.withColumn("weight", F.round("weight", 6))


@query
def deal_channel_links_default(t):
    """At the operator's own window and half-life."""
    links = T.deal_links(t.deals, _touches(t), t.accounts)
    return links.select(
        "opp_id", "channel", "touches", "first_us", "last_us", F.round("weight", 6).alias("weight")
    )


@query
def attr_all_models_default(t):
    """At the operator's own window and half-life."""
    credits = M.attribution(t.deals, _touches(t), t.accounts)
    return rounded(credits, 4, "attributed_pipeline", "attributed_won")


@query
def attr_sourced(t):
    return _credits(t, V.SOURCED)


@query
def attr_influenced(t):
    return _credits(t, V.INFLUENCED)


@query
def attr_first(t):
    return _credits(t, V.FIRST_TOUCH)


@query
def attr_last(t):
    return _credits(t, V.LAST_TOUCH)


@query
def attr_linear(t):
    return _credits(t, V.LINEAR)


@query
def attr_time_decay(t):
    return _credits(t, V.TIME_DECAY)


@query
def attr_all_models(t):
    return _credits(t)


def _snake(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower().replace("-", "_").replace(" ", "_") for c in df.columns))


@query
def attr_comparison(t):
    wide = M.compare_models(_attribution(t))
    return _snake(rounded(wide, 4, *V.ATTRIBUTION_MODELS))


@query
def attr_shift(t):
    return rounded(M.model_shift(_attribution(t, V.FIRST_TOUCH, V.LAST_TOUCH)), 2, "before", "after", "shift")


@query
def attr_best_model(t):
    return M.best_models(_attribution(t)).select("channel", "best_model")


@query
def attr_report(t):
    return M.attribution_report(_attribution(t))


@query
def sourced_vs_influenced(t):
    row = M.sourced_versus_influenced(t.deals, _attribution(t, V.SOURCED, V.INFLUENCED))
    return rounded(row, 2, *row.columns)


# --- advanced --------------------------------------------------------------


def _coverage(t: Tables) -> DataFrame:
    return X.coverage(t.accounts, t.reached_email, t.reached_display, t.opps)


@query
def coverage_accounts(t):
    return _coverage(t)


@query
def coverage_accounts_marks(t):
    """The same rows, memberships kept as bits."""
    return X.coverage_by_marks(t.accounts, t.reached_email, t.reached_display, t.opps)


def _campaign_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Numbers of the touch campaigns, and which of them reached each domain, year by year merged."""
    log = _touches(t).withColumn("value", F.concat_ws("/", "channel", "touch_type", "campaign_id"))
    codes = keep(dictionary(log, "value"), "campaign-codes")
    early = F.coalesce(F.year("touch_date") % 2 == 0, F.lit(False))
    parts = (memberships(log.where(x), "domain", "value", codes) for x in (early, ~early))
    return codes, merged(*parts)


@query
def segment_sets(t):
    """Segments of each domain, from bits over the numbered segments."""
    codes = keep(dictionary(t.segments, "segment"), "segment-codes")
    sets = listed(memberships(t.segments, "domain", "segment", codes), "domain", codes, "segments")
    return sets.withColumn("segments", F.array_join("segments", "|"))


@query
def campaign_sets(t):
    """Channel, type and campaign of the touches that reached each domain."""
    codes, sets = _campaign_sets(t)
    return listed(sets, "domain", codes, "campaigns").withColumn("campaigns", F.array_join("campaigns", "|"))


@query
def channel_combinations(t):
    """How many domains each combination of channels reached."""
    codes = keep(dictionary(_touches(t), "channel"), "channel-codes")
    sets = listed(memberships(_touches(t), "domain", "channel", codes), "domain", codes, "channels")
    return sets.groupBy(F.array_join("channels", "|").alias("channels"), "n_channels").agg(
        F.count("*").alias("domains")
    )


@query
def channel_audience(t):
    """Domains by the channels that reached them: all of some, any of others, none of a third list."""
    log = _touches(t)
    codes = keep(dictionary(log, "channel"), "channel-codes")
    members = memberships(log, "domain", "channel", codes)
    return having(members, "domain", codes, **B.AUDIENCE)


@query
def coverage_summary(t):
    rows = X.coverage_summary(_coverage(t))
    rows = rows.withColumn("tier_no", F.col("tier_no").cast("bigint"))
    return rounded(rows, 6, "pct_of_total", "opp_rate")


def _closed(t: Tables) -> DataFrame:
    return t.opps.join(t.closings, "opp_id", "left")


@query
def velocity_channel(t):
    return rounded(X.velocity(_closed(t)), 6, "mean_days")


@query
def velocity_segment(t):
    rows = X.velocity(_closed(t), "segment").drop("p25", "p75")
    return rounded(rows, 6, "mean_days")


def _journeys(t: Tables) -> DataFrame:
    # By the deal's own domain, as the stage runner does it.
    return J.journeys(t.deals, T.touchpoints(t.campaign, t.email))


@query
def journeys(t):
    return _journeys(t)


@query
def journey_top_sequences(t):
    return rounded(J.top_sequences(_journeys(t)), 2, "pipeline")


@query
def journey_first_channel(t):
    return J.first_channels(_journeys(t))


def _rates(df: DataFrame) -> DataFrame:
    money = [c for c in ("pipeline", "won_pipeline", "avg_deal") if c in df.columns]
    return rounded(rounded(df, 2, *money), 6, "win_rate")


@query
def qualified_performance(t):
    return _rates(X.qualified_performance(t.opps, t.accounts))


@query
def profile_fit_performance(t):
    return _rates(X.profile_fit_performance(t.opps, t.accounts))


@query
def targeting_matrix(t):
    return rounded(_rates(X.targeting_matrix(t.opps, t.accounts)), 4, "priority_score")


@query
def targeting_pivot(t):
    wide = X.targeting_pivot(X.targeting_matrix(t.opps, t.accounts), B.FITS)
    return _snake(rounded(wide, 6, *B.FITS, "Other"))


@query
def cohort_quarterly(t):
    return rounded(_rates(X.cohorts(t.opps)), 6, "marketing_share")


@query
def cohort_last(t):
    """The last four quarters of the cohorts."""
    return last_n(rounded(_rates(X.cohorts(t.opps)), 6, "marketing_share"), "quarter", 4)


@query
def winning_channels(t):
    shown = ["channel_category", "won_pipeline", "win_rate", "win_percent"]
    rows = C.winning_channels(_channels(t)).select(*shown)
    return rounded(rounded(rows, 2, "won_pipeline"), 6, "win_rate", "win_percent")


@query
def attr_channels_above(t):
    return rounded(M.channels_above(_attribution(t)), 4, "attributed_pipeline")


@query
def raw_exports(t):
    """A raw export written as CSV and scanned again, all cells as text."""
    out = f"{shared_folder(t.spark)}/raw-{uuid.uuid4().hex}"
    t.raw_campaign.write.option("header", True).option("escape", '"').csv(f"{out}/campaign.csv")
    return read_raw(t.spark, out, "campaign", {"campaign": "campaign.csv"})


@query
def rejected_cells(t):
    """Filled and rejected cells of every typed column of all eight exports."""
    counted = None
    for name in sorted(TABLES):
        part = cell_counts(getattr(t, f"raw_{name}"), name).withColumn("table", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    return counted.select("table", "column", "type", "rows", "filled", "rejected")


@query
def malformed_lines(t):
    """Campaign lines written as text, some a cell short and some a cell long, scanned and counted."""
    out = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    columns = ["_6sensedomain", "_spend", "_clicks", "_date"]
    raw = t.raw_campaign
    spoilt = F.col("_clicks") == "2"
    cells = [F.col("_6sensedomain"), F.col("_spend"), F.col("_clicks"), F.when(~spoilt, F.col("_date"))]
    long = F.when(F.col("_spend") == "null", F.lit("one more"))
    raw.select(F.concat_ws(",", *cells, long)).write.text(f"{out}/campaign.csv")
    lines = read_checked(t.spark, out, "campaign", columns, header=False)
    return line_counts(lines)


@query
def touches_without_web(t):
    """The touch log where the optional web table has not been written."""
    absent = read_table_or_empty(t.spark, f"{shared_folder(t.spark)}/none", "web")
    log = T.touchpoints(t.campaign, t.email, absent)
    rows = T.touch_summary(log)
    return rows.select("channel", "touch_type", "touches", "domains", micros("first_touch"), micros("last_touch"))


@query
def stored_tables(t):
    """Campaign rows and a report, written as stage tables and read again."""
    out = f"{shared_folder(t.spark)}/stored-{uuid.uuid4().hex}"
    write_table(t.campaign, out, "campaign", month_of="activity_date")
    write_report({"monthly": R.monthly_campaign(t.campaign)}, out, "campaign")
    rows = read_table(t.spark, out, "campaign").groupBy("month").agg(
        F.count("*").alias("rows"), F.sum("impressions").alias("impressions")
    )
    months = read_report(t.spark, out, "campaign", "monthly").select(F.col("month_year").alias("month"), "spend")
    joined = rows.withColumn("month", F.col("month").cast("string")).join(months, "month")
    return rounded(joined, 2, "spend")


# --- dashboards ------------------------------------------------------------


@query
def monthly_pipeline(t):
    return rounded(R.monthly_pipeline(t.opps), 2, "pipeline")


@query
def monthly_campaign(t):
    return rounded(R.monthly_campaign(t.campaign), 2, "spend")


@query
def kpis(t):
    row = rounded(R.kpis(t.opps), 2, "total_pipeline", "won_pipeline", "marketing_pipeline")
    return rounded(row, 6, "win_rate", "marketing_share")


@query
def campaign_kpis(t):
    return rounded(rounded(R.campaign_kpis(t.campaign), 2, "spend"), 6, "ctr", "cost_per_fill")


@query
def email_kpis(t):
    rates = ["open_rate", "click_rate", "register_rate", "click_to_open"]
    return rounded(R.email_kpis(t.email), 6, *rates)


@query
def web_kpis(t):
    return R.web_kpis(t.web)


@query
def traffic_mix(t):
    return R.traffic_mix(t.web)


@query
def open_by_stage(t):
    return rounded(R.open_by_stage(t.opps), 2, "pipeline")


@query
def pipeline_by_segment(t):
    return rounded(R.pipeline_by_segment(t.opps), 2, "pipeline")


@query
def lost_reasons(t):
    return R.lost_reasons(t.opps)


@query
def fit_distribution(t):
    return R.fit_distribution(t.accounts)


@query
def contacts_by_seniority(t):
    return count_by(t.contacts, "seniority", "contacts")


@query
def deals_by_channel_segment(t):
    return _rates(deal_summary(t.opps, ["channel_category", "segment"]))


@query
def industry_segment_matrix(t):
    levels = ["Enterprise", "Mid-Market"]
    wide = R.industry_segment_matrix(_master(t), levels)
    return _snake(rounded(wide, 2, *levels, "Other", "row_total"))


@query
def rows_json(t):
    channels = _channels(t).select(
        "channel_category", "deal_count", "won_count", "win_rate", "pipeline_roi"
    )
    return rows_as_json(channels)


@query
def channel_rows_json(t):
    rows = C.channel_rows(_channels(t))
    money = ["total_pipeline", "won_pipeline", "avg_deal_size", "channel_spend"]
    # To the cent, as decimals, whose digits every JSON writer spells alike.
    return rows_as_json(rows.withColumns({c: F.round(c, 2).cast("decimal(18,2)") for c in money}))


@query
def attribution_rows_json(t):
    rows = M.attribution_rows(_attribution(t))
    return rows_as_json(rounded(rows, 4, *rows.columns[1:]))


@query
def reconciliation(t):
    """Totals seen by the tasks that write the stage tables; one column is read again, for distinct deals."""
    stored = Tables(t.spark, t.folder)
    stages = {name: getattr(t, name) for name in ("opps", "campaign", "ads", "email", "web")}
    # Of the widest table, the columns that any of the later stages reads.
    stages["ads"] = stages["ads"].select("platform", "spend", "clicks", "impressions")
    made, totals = keep_all_measured(stages)
    for name, df in made.items():
        setattr(stored, name, df)
    channels, totals["channels"] = keep_measured(_channels(stored), "channels", "stage-channels")
    later = {
        "report": C.channel_roi_report(channels),
        "master": _master(stored),
        "funnel": funnel(stored.campaign, stored.ads, stored.email, stored.web, stored.opps),
        "attribution": _attribution(stored, V.INFLUENCED, V.FIRST_TOUCH),
    }
    totals |= keep_all_measured(later)[1]
    distinct = stored.opps.agg(distinct_deals(stored.opps).cast("double")).first()[0]
    totals["opps"][("expected", UNIQUE)] = distinct
    return rounded(reconcile_totals(t.spark, totals), 2, "actual", "expected")


# --- win model -------------------------------------------------------------


def _features(t: Tables) -> DataFrame:
    return W.win_features(t.opps, _master(t))


@query
def win_features(t):
    shown = ["opp_id", "is_closed_deal", "label", "industry", "tier", "profile_fit", "email_opens"]
    return _features(t).select(*shown, "c_level_contacts")


# Where the stored models of this process lie, by session, folder and the tables' times of writing.
_FITTED: dict[tuple, str] = {}
FIT_TABLES = ("orders", "customer", "nation", "region", "events")


def _model(t: Tables) -> str:
    """One fit for all queries on the same tables: the folder where it is stored."""
    times = tuple(B.written_at(t.spark, f"{t.folder}/{name}.parquet") for name in FIT_TABLES)
    key = (t.spark.sparkContext.applicationId, t.folder, times)
    if key not in _FITTED:
        of_data = t.spark.sql(B.DATA_KEY, **{n: t.given(n) for n in ("orders", "customer", "events")}).first()[0]
        _FITTED[key] = W.store_win_model(_features(t), f"{shared_folder(t.spark)}/{B.WIN_STORE}", of_data)
    return _FITTED[key]


def _scores(t: Tables) -> DataFrame:
    return W.stored(t.spark, _model(t), "scores")


@query
def win_probability(t):
    return W.ranked(_scores(t))


@query
def win_inputs(t):
    """Codes of the categories and filled numbers, as the forest gets them."""
    numbers = ["is_qualified", "intent_score", "annual_revenue", "email_opens", "c_level_contacts", "amount"]
    return W.model_inputs(_features(t), V.WIN_CATEGORICAL, numbers)


@query
def win_folds(t):
    """Closed deals by fold and label."""
    dealt = W.stratified_folds(_features(t))
    return dealt.groupBy(F.col(W.FOLD).cast("bigint").alias("fold"), "label").agg(F.count("*").alias("deals"))


@query
def win_auc(t):
    """Over stored scores of forests that have not seen the deal."""
    folder = _model(t)
    if not B.exists(t.spark, f"{folder}/fold_scores/_SUCCESS"):
        ready = t.spark.read.parquet(f"{folder}/ready").first()
        scores = W.out_of_fold_scores(W.stored(t.spark, folder, "deals"))
        scores = scores.withColumns({"key": F.lit(ready.key), "version": F.lit(ready.version)})
        scores.write.mode("overwrite").parquet(f"{folder}/fold_scores")
    return rounded(W.auc_summary(W.stored(t.spark, folder, "fold_scores")), 9, "auc", "deviation")


@query
def win_nodes(t):
    """The stored forest by depth-free totals: nodes, leaves and training deals of every tree."""
    nodes = W.stored(t.spark, _model(t), "nodes")
    leaf = F.col("feature").isNull()
    return nodes.groupBy(F.col("tree").cast("bigint").alias("tree")).agg(
        F.count("*").alias("nodes"),
        F.count_if(leaf).alias("leaves"),
        F.sum(F.when(leaf, F.col("n"))).alias("drawn"),
        F.sum(F.when(leaf, F.col("won"))).alias("won"),
    )


@query
def feature_importance(t):
    return rounded(W.node_importance(W.stored(t.spark, _model(t), "nodes")), 9, "importance")


@query
def win_accuracy(t):
    return W.accuracy(_scores(t))


@query
def win_histogram(t):
    return W.win_histogram(W.ranked(_scores(t)))
