import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealtrace.functions import fixed_values as V
from dealtrace.operators import deal_summary
from dealtrace.plans import account360 as A
from dealtrace.plans import advanced as X
from dealtrace.plans import attribution as M
from dealtrace.plans import channel as C
from dealtrace.plans import clean as L
from dealtrace.plans import journey as J
from dealtrace.plans import reports as R
from dealtrace.plans import touch as T
from dealtrace.plans.funnel import funnel
from dealtrace.sources import TABLES, conform, find_column

DAY = dt.datetime(2024, 5, 1)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


# --- cleaning --------------------------------------------------------------


def test_clean_opportunities_from_raw_names(spark):
    raw = spark.createDataFrame(
        [
            ("o1", "1", "100", "null", "1/2/2024", "Marketing: MQA", " Enterprise ", "Open", "5", None),
            ("o1", "2", None, "True", "", "Marketing: MQA", None, "Closed Won", "6", "Price"),
            ("o2", "x", "abc", "no", "2024-03-04", "Cold Call", "S", None, "1", "-"),
        ],
        "_opportunity_id string, _order string, _amount string, iswon string, _createdate string, "
        "_leadsource string, segment__c string, _current_stage string, _days_current_stage string, "
        "_lostreason string",
    )
    got = rows_of(L.clean_opportunities(raw), "opp_id")
    first = got["o1"]
    assert (first.amount, first.is_won, first.segment, first.stage) == (100.0, True, "Enterprise", "Closed Won")
    assert first.create_date == dt.datetime(2024, 1, 2)
    assert (first.channel_category, first.is_marketing_sourced) == ("email_mqa", True)
    assert (first.stage_days, first.lost_reason, first.acv) == (6.0, "Price", None)
    second = got["o2"]
    assert (second.amount, second.is_won, second.lost_reason) == (None, False, None)
    assert (second.channel_category, second.is_marketing_sourced) == ("sales", False)


def test_won_flag_takes_either_spelling(spark):
    raw = spark.createDataFrame(
        [("a", "1", "null", "True"), ("b", "1", "False", "True")],
        "_opportunity_id string, _order string, iswon string, _iswon string",
    )
    got = rows_of(L.clean_opportunities(raw), "opp_id")
    assert (got["a"].is_won, got["b"].is_won) == (True, False)


def test_every_cleaner_takes_an_empty_export(spark):
    for name, cleaner in L.CLEANERS.items():
        fields = ", ".join(f"`{(f.raw or (f.name,))[0]}` string" for f in TABLES[name].fields)
        cleaned = cleaner(spark.createDataFrame([], fields))
        assert cleaned.count() == 0
        types = dict(cleaned.dtypes)
        for f in TABLES[name].fields:
            assert types[f.name] == f.type, (name, f.name)


def test_load_columns_go_and_others_stay(spark):
    raw = spark.createDataFrame(
        [("1", "x", "A.com", "k")], "` _sdc_sequence` string, _emails string, _domain string, extra string"
    )
    cleaned = L.clean_contacts(raw)
    assert "extra" in cleaned.columns
    assert not {"_emails", "_sdc_sequence", " _sdc_sequence"} & set(cleaned.columns)
    assert cleaned.first().domain == "a.com"


def test_column_lookup():
    names = ["_days_current_stage", " _Current_Stage", "CreateDate__c"]
    assert find_column(names, pattern=r"^(?!.*days).*current_?stage") == " _Current_Stage"
    assert find_column(names, ("createdate__c",)) == "CreateDate__c"
    assert find_column(names, ("nope",)) is None


def test_conform_adds_missing_columns(spark):
    df = conform(spark.createDataFrame([("a",)], "_domain string"), "web")
    assert df.columns == [f.name for f in TABLES["web"].fields]
    assert df.first().utm_source is None


# --- account table ---------------------------------------------------------


def _frame(spark, table, rows, *extra):
    """Rows given as dicts over a table's own columns and extra ones."""
    fields = [(f.name, f.type) for f in TABLES[table].fields] + [tuple(e.split(":")) for e in extra]
    schema = ", ".join(f"{n} {t}" for n, t in fields)
    return spark.createDataFrame([tuple(r.get(n) for n, _ in fields) for r in rows], schema)


@pytest.fixture(scope="module")
def world(spark):
    accounts = _frame(
        spark,
        "accounts",
        [
            {"account_id": "1", "domain": "a.com", "industry": "I", "profile_fit": "Strong", "is_qualified": True},
            {"account_id": "2", "domain": "a.com", "industry": "I", "profile_fit": "Weak"},
            {"account_id": "3", "industry": "J", "is_qualified": False},
        ],
    )
    segments = _frame(
        spark,
        "segments",
        [
            {"domain": "a.com", "segment": "s2", "activity_date": DAY, "employee_range": "e"},
            {"domain": "a.com", "segment": "s1", "activity_date": DAY + dt.timedelta(days=1)},
            {"domain": "a.com", "segment": "s2", "activity_date": None},
        ],
        "segment_category:string",
    )
    campaign = _frame(spark, "campaign", [{"domain": "a.com", "spend": 2.0, "form_fills": 1}, {"domain": None, "spend": 9.0}])
    email = _frame(
        spark,
        "email",
        [{"domain": "a.com", "campaign_id": c, "is_open": True, "is_click": False, "is_register": c == "y"} for c in "xxy"],
        "is_open:boolean",
        "is_click:boolean",
        "is_register:boolean",
    )
    web = _frame(spark, "web", [{"domain": "b.com", "session_views": 3.0}])
    opps = _frame(
        spark,
        "opportunities",
        [
            {"opp_id": "o1", "account_id": "1", "amount": 10.0, "is_won": True, "lead_source": None, "domain": "a.com"},
            {"opp_id": "o2", "account_id": "1", "amount": 5.0, "is_won": None, "lead_source": "L", "segment": "S"},
            {"opp_id": "o3", "account_id": "9", "amount": None, "account_name": "Nine"},
            {"opp_id": "o4", "account_id": None, "amount": 1.0},
        ],
        "channel_category:string",
        "is_marketing_sourced:boolean",
    )
    contacts = _frame(
        spark,
        "contacts",
        [{"account_id": "1", "seniority": s} for s in ("VP", "vp", "C-Level")] + [{"account_id": "7", "seniority": "VP"}],
    )
    return accounts, segments, campaign, email, web, opps, contacts


def test_account_table(world):
    got = rows_of(A.account360(*world), "account_id")
    assert set(got) == {"1", "2", "3", "9"}  # the contact-only account is not added
    one, two, three, nine = (got[k] for k in "1239")
    assert one.segment_list == ["s1", "s2"] and one.emp_range == "e"
    assert (one.campaign_spend, one.email_opens, one.unique_email_campaigns) == (2.0, 3, 2)
    assert (one.total_pipeline, one.total_won, one.deal_count) == (15.0, 10.0, 2)
    assert (one.primary_leadsource, one.vp_contacts, one.c_level_contacts) == ("L", 2, 1)
    assert one.web_sessions is None
    assert two.campaign_spend == 2.0 and two.deal_count is None  # shares the domain, not the deals
    assert three.segment_list is None and three.contact_count is None
    assert (nine.account_name, nine.total_pipeline, nine.industry) == ("Nine", 0.0, None)


def test_orphans_and_industries(world):
    accounts, *_, opps, _ = world
    assert rows_of(A.orphan_accounts(accounts, opps), "account_id")["9"].account_name == "Nine"
    rows = A.industry_pipeline(A.account360(*world)).collect()
    assert [(r.industry, r.accounts, r.pipeline) for r in rows] == [("I", 2, 15.0), ("J", 1, 0.0)]


def test_qualified_and_matrix_leave_unknown_accounts_out(world):
    accounts, *_, opps, _ = world
    got = rows_of(X.qualified_performance(opps, accounts), "is_qualified")
    assert set(got) == {True}
    assert (got[True].deals, got[True].won, got[True].pipeline, got[True].avg_deal) == (2, 1, 15.0, 7.5)
    matrix = X.targeting_matrix(opps, accounts).collect()
    assert [(r.segment, r.profile_fit, r.deals, r.priority_score) for r in matrix] == [("S", "Strong", 1, 0.0)]


# --- channels, funnel, budget ----------------------------------------------


def _opps(spark, rows):
    return spark.createDataFrame(
        rows, "opp_id string, channel_category string, amount double, is_won boolean, is_marketing_sourced boolean"
    )


def test_channel_pipeline(spark):
    opps = _opps(spark, [("1", "linkedin", 10.0, True, True), ("2", "linkedin", 30.0, None, True), ("3", "sales", 60.0, False, False)])
    ads = spark.createDataFrame([("LinkedIn", 5.0), ("LinkedIn", 5.0), ("Else", 99.0)], "platform string, spend double")
    got = rows_of(C.channel_pipeline(opps, ads), "channel_category")
    social, sales = got["linkedin"], got["sales"]
    assert (social.channel_spend, social.pipeline_roi, social.revenue_roi, social.cost_per_opp) == (10.0, 4.0, 1.0, 5.0)
    assert (social.win_rate, social.pipeline_pct) == (0.5, 0.4)
    assert (sales.channel_spend, sales.pipeline_roi, sales.cost_per_opp) == (0.0, None, 0.0)


def _channels(spark, rows):
    return spark.createDataFrame(rows, "channel_category string, channel_spend double, total_pipeline double, pipeline_roi double")


def test_budget_factors_compound_on_two_channels(spark):
    channels = _channels(spark, [("6sense_display", 10.0, 50.0, 5.0), ("linkedin", 10.0, 20.0, 2.0), ("sales", 0.0, 9.0, None)])
    got = rows_of(C.budget_scenarios(channels), "scenario", "channel_category")
    assert len(got) == 6
    assert got["ROI-Optimized", "linkedin"].spend == pytest.approx(10.4)
    assert got["Growth Mode", "6sense_display"].spend == pytest.approx(10.0)
    assert got["Growth Mode", "linkedin"].projected_pipeline == pytest.approx(10.0)
    alone = rows_of(C.budget_scenarios(channels, overlap="exclusive"), "scenario", "channel_category")
    assert alone["ROI-Optimized", "linkedin"].spend == pytest.approx(13.0)
    totals = rows_of(C.budget_totals(C.budget_scenarios(channels)), "scenario")
    assert totals["Status Quo"].gain == 0.0
    assert totals["ROI-Optimized"].gain == pytest.approx(2.8)


def test_funnel_on_nothing_has_nine_zero_stages(spark):
    empty = [
        _frame(spark, "campaign", []),
        _frame(spark, "ads", []),
        _frame(spark, "email", [], "is_click:boolean"),
        _frame(spark, "web", []),
        _frame(spark, "opportunities", [], "is_marketing_sourced:boolean"),
    ]
    rows = funnel(*empty).orderBy("stage_no").collect()
    assert [r.stage for r in rows] == V.FUNNEL_STAGES
    assert all(r["count"] == 0 and r.conversion_from_prev is None for r in rows)


def test_creative_drops_all_null_attributes_and_fills_the_rest(spark):
    ads = spark.createDataFrame(
        [("a", None, "P", 1.0, 2.0, 4.0, 1.0), ("a", "red", "P", 1.0, 0.0, 4.0, 1.0)],
        "ad_name string, design_color string, platform string, spend double, clicks double, impressions double, pageviews double",
    ).withColumn("size", F.lit(None).cast("string"))
    creative = R.creative_performance(ads)
    assert "size" not in creative.columns
    got = rows_of(creative, "design_color")
    assert (got["Unknown"].ctr, got["Unknown"].landing_cvr, got["red"].cpc) == (0.5, 0.5, None)
    by = rows_of(R.creative_by_attribute(creative), "attribute", "value")
    assert set(by) == {("design_color", "Unknown"), ("design_color", "red")}
    assert [r.ctr for r in R.top_creatives(creative, 1).collect()] == [0.5]


def test_creative_without_any_attribute_is_empty(spark):
    ads = spark.createDataFrame([(1.0, 2.0, 4.0, 1.0)], "spend double, clicks double, impressions double, pageviews double")
    creative = R.creative_performance(ads)
    assert creative.count() == 0
    assert R.top_creatives(creative).count() == 0
    assert R.creative_by_attribute(creative).count() == 0
    assert R.creative_by_platform(creative).count() == 0


def test_contacts_have_both_levels(spark):
    contacts = spark.createDataFrame([("VP", "Lead"), ("VP", None), ("VP", "Lead")], "seniority string, lifecycle_stage string")
    got = rows_of(R.contacts_by_seniority_stage(contacts), "lifecycle_stage", "is_total")
    assert {k: r.contacts for k, r in got.items()} == {("Lead", False): 2, (None, True): 3}


def test_cohort_of_deals_without_date(spark):
    opps = spark.createDataFrame(
        [("1", None, 5.0, True, True), ("2", DAY, 5.0, None, False)],
        "opp_id string, create_date timestamp, amount double, is_won boolean, is_marketing_sourced boolean",
    )
    assert set(rows_of(X.cohorts(opps), "quarter")) == {"2024Q2"}
    assert set(rows_of(X.cohorts(opps, "NaT"), "quarter")) == {"2024Q2", "NaT"}


# --- touches, attribution, journeys ---------------------------------------


@pytest.fixture(scope="module")
def touched(spark):
    campaign = _frame(
        spark,
        "campaign",
        [
            {"domain": "a.com", "activity_date": DAY, "latest_impression": DAY + dt.timedelta(days=1)},
            {"domain": "a.com", "activity_date": DAY + dt.timedelta(days=2)},
            {"domain": None, "activity_date": DAY},
        ],
    )
    email = _frame(
        spark,
        "email",
        [
            {"domain": "a.com", "event_time": DAY + dt.timedelta(days=3), "is_click": True, "is_register": True},
            {"domain": "b.com", "event_time": DAY - dt.timedelta(days=400), "is_click": False, "is_register": True},
        ],
        "is_click:boolean",
        "is_register:boolean",
    )
    web = _frame(spark, "web", [{"domain": "b.com", "event_time": DAY, "utm_source": None}])
    accounts = _frame(spark, "accounts", [{"account_id": "2", "domain": "b.com"}])
    opps = _frame(
        spark,
        "opportunities",
        [
            {"opp_id": "1", "domain": "http://A.com/", "create_date": DAY + dt.timedelta(days=4), "amount": 100.0, "is_won": True},
            {"opp_id": "2", "account_id": "2", "create_date": DAY, "amount": 50.0, "is_won": False},
            {"opp_id": "3", "domain": "a.com", "create_date": DAY + dt.timedelta(days=4), "amount": None},
            {"opp_id": "4", "domain": "c.com", "create_date": DAY, "amount": 7.0, "is_won": True},
        ],
        "channel_category:string",
        "is_marketing_sourced:boolean",
    ).withColumns({"channel_category": F.concat(F.lit("crm"), "opp_id"), "is_marketing_sourced": F.col("opp_id") != "2"})
    return opps, T.touchpoints(campaign, email, web), accounts, T.touchpoints(campaign, email)


def test_touch_log(touched):
    types = [r.touch_type for r in touched[1].collect()]
    assert sorted(types) == ["ad_impression", "ad_impression", "email_click", "email_register", "web_visit_other"]


def test_six_models(touched):
    opps, log, accounts, _ = touched
    got = rows_of(M.attribution(opps, log, accounts), "attribution_model", "channel")
    pipeline = {k: r.attributed_pipeline for k, r in got.items()}
    assert pipeline[V.SOURCED, "crm3"] == 0.0 and pipeline[V.SOURCED, "crm4"] == 7.0
    assert {c for m, c in got if m == V.INFLUENCED} == {"crm1", "crm2"}
    assert pipeline[V.FIRST_TOUCH, "6sense_display"] == 100.0
    assert pipeline[V.LAST_TOUCH, "email_mqa"] == 100.0
    assert pipeline[V.LINEAR, "6sense_display"] == pipeline[V.LINEAR, "email_mqa"] == 50.0
    assert pipeline[V.LINEAR, "web_inbound"] == 50.0
    ages = {"6sense_display": (3, 2), "email_mqa": (1,)}
    weights = {c: sum(2 ** (-a / 30) for a in v) for c, v in ages.items()}
    share = weights["email_mqa"] / sum(weights.values())
    assert pipeline[V.TIME_DECAY, "email_mqa"] == pytest.approx(100 * share)
    assert got[V.LINEAR, "web_inbound"].attributed_won == 0.0


def test_models_agree_on_the_total(touched):
    opps, log, accounts, _ = touched
    results = M.attribution(opps, log, accounts)
    totals = {
        r.attribution_model: r.p
        for r in results.groupBy("attribution_model").agg(F.sum("attributed_pipeline").alias("p")).collect()
    }
    for model in M.TOUCH_MODELS:
        assert totals[model] == pytest.approx(150.0)


def test_own_domains_only(touched):
    opps, log, accounts, _ = touched
    got = M.attribution(opps, log, accounts, [V.FIRST_TOUCH], domain_source="own_only").collect()
    assert [(r.channel, r.attributed_pipeline) for r in got] == [("6sense_display", 100.0)]


def test_comparison_tables(touched):
    opps, log, accounts, _ = touched
    results = M.attribution(opps, log, accounts).cache()
    wide = rows_of(M.compare_models(results), "channel")
    assert wide["crm4"][V.SOURCED] == 7.0 and wide["crm4"][V.LINEAR] == 0.0
    shift = rows_of(M.model_shift(results), "channel")
    assert (shift["6sense_display"]["shift"], shift["email_mqa"]["shift"]) == (-100.0, 100.0)
    row = M.sourced_versus_influenced(opps, results).first()
    assert (row.total_pipeline, row.sourced, row.influenced, row.not_influenced) == (157.0, 107.0, 150.0, 7.0)
    results.unpersist()


def test_unknown_model_is_refused(touched):
    with pytest.raises(ValueError):
        M.attribution(*touched[:3], models=["Best"])


def test_journeys(touched):
    opps, *_, log = touched
    got = rows_of(J.journeys(opps, log), "opp_id")
    assert set(got) == {"1"}
    one = got["1"]
    assert (one.n_touches, one.n_channels, one.first_channel, one.last_channel) == (3, 2, "6sense_display", "email_mqa")
    assert one.sequence == one.sequence_2ch == "6sense_display -> email_mqa"
    assert J.top_sequences(J.journeys(opps, log)).first().pipeline == 100.0


def test_coverage_has_every_tier(spark):
    def domains(*names):
        return spark.createDataFrame([(n,) for n in names], "domain string")

    covered = X.coverage(domains("a", "B ", "c", "d", None, "a"), domains("A", "b", "z"), domains("a", "c"), domains("d"))
    got = rows_of(covered, "domain")
    assert {k: r.coverage_tier for k, r in got.items()} == dict(zip("abcd", V.COVERAGE_TIERS))
    assert got["a"].reached_count == 2 and got["d"].has_opportunity
    rows = X.coverage_summary(covered).collect()
    assert [r.coverage_tier for r in rows] == V.COVERAGE_TIERS
    assert [r.pct_of_total for r in rows] == [0.25] * 4 and rows[-1].opp_rate == 1.0


def test_velocity_range(spark):
    def deal(hours, won=True):
        return ("k", DAY, DAY + dt.timedelta(hours=hours), won)

    opps = spark.createDataFrame(
        [deal(23), deal(24), deal(24 * 3), deal(24 * 730), deal(24 * 731), deal(24 * 5, False)],
        "channel_category string, create_date timestamp, close_date timestamp, is_won boolean",
    )
    row = X.velocity(opps).first()
    assert (row.deal_count, row.median_days, row.p25) == (3, 3.0, 2.0)


def test_segment_summary_ignores_null_keys(spark):
    opps = spark.createDataFrame([("1", None, 1.0, True)], "opp_id string, segment string, amount double, is_won boolean")
    assert deal_summary(opps, "segment").count() == 0
