"""SQL twins of the registered queries, for DuckDB over the same tables.

Written straight from the definitions (pairs of deals and touches, plain joins
and windows), so that they share no method with the Spark plans they check.
"""

from __future__ import annotations

from ..functions import fixed_values as V
from . import bindings as B

ORACLES: dict[str, str] = {}


def twin(name: str, body: str, *tables: str, more: str = "") -> None:
    """Register: WITH <bound tables>[, more] body."""
    head = B.cte(*tables) if tables else ""
    if more:
        head = f"{head},\n{more}" if head else f"WITH {more}"
    ORACLES[name] = f"{head}\n{body}".strip()


def div(a: str, b: str, digits: int | None = None, scale: str = "") -> str:
    value = f"({a}) / nullif(CAST({b} AS DOUBLE), 0){scale}"
    return value if digits is None else nearest(value, digits)


def nearest(expr: str, digits: int) -> str:
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


def money(expr: str, digits: int = 2) -> str:
    return f"round(coalesce(sum({expr}), 0), {digits})"


def n_if(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def trim(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def clean(expr: str) -> str:
    return f"CASE WHEN {expr} NOT IN ('null', 'NULL', 'None', '-', '') THEN {expr} END"


def number(expr: str) -> str:
    return f"TRY_CAST({clean(expr)} AS DOUBLE)"


def when(expr: str) -> str:
    text = clean(expr)
    return f"coalesce(TRY_CAST({text} AS TIMESTAMP), try_strptime({text}, '%m/%d/%Y'))"


def domain(expr: str) -> str:
    text = f"lower({trim(clean(expr))})"
    text = f"regexp_replace(regexp_replace({text}, '^https?://', ''), '^www[.]', '')"
    text = f"regexp_replace({text}, '/+$', '')"
    return f"CASE WHEN {text} NOT IN ('nan', 'none', '') THEN {text} END"


def month(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m')"


# --- changelog, cleaning ---------------------------------------------------

_TIES = "l_partkey * 100000000 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
_LOG = f"""log AS (
  SELECT l_orderkey AS id, nullif(l_linenumber, 7) AS version, nullif(l_returnflag, 'N') AS flag,
    CASE WHEN l_quantity < 45 THEN l_extendedprice END AS amount, l_linestatus AS stage,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY nullif(l_linenumber, 7) NULLS LAST, {_TIES}) AS rn
  FROM lineitem)"""
_MERGED = ", ".join(
    f"arg_max({c}, rn) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in ("version", "flag", "amount", "stage")
)
twin("latest_state_merge", f"SELECT id, {_MERGED} FROM log GROUP BY id", more=_LOG)
twin("latest_state_incremental", f"SELECT id, {_MERGED} FROM log GROUP BY id", more=_LOG)
twin(
    "latest_state_row",
    """SELECT id, version, flag, amount, stage FROM log
QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1""",
    more=_LOG,
)

_OPP_COLUMNS = {
    "version": number("_order"),
    "amount": number("_amount"),
    "create_date": when("_createdate"),
    "won_text": clean("iswon"),
    "lead_source": clean("_leadsource"),
    "segment_text": clean("segment__c"),
    "stage": clean("_current_stage"),
}
twin(
    "clean_opportunities",
    """SELECT opp_id, version, amount, epoch_us(create_date) AS create_date,
  CASE WHEN won_text IN ('True', 'true', '1', 'yes') THEN true
    WHEN won_text IN ('False', 'false', '0', 'no') THEN false END AS is_won,
  lead_source,
  CASE lead_source WHEN 'Marketing: MQA' THEN 'email_mqa' WHEN 'Web Inbound' THEN 'web_inbound'
    WHEN 'Cold Call' THEN 'sales' ELSE 'other' END AS channel_category,
  coalesce(lead_source IN ('Marketing: MQA', 'Web Inbound'), false) AS is_marketing_sourced,
  trim(segment_text) AS segment, stage
FROM merged""",
    "raw_opportunities",
    more=f"""typed AS (SELECT _opportunity_id AS opp_id, CAST(row_key AS BIGINT) AS row_key,
  {", ".join(f"{e} AS {c}" for c, e in _OPP_COLUMNS.items())} FROM raw_opportunities),
ranked AS (SELECT *, row_number() OVER (PARTITION BY opp_id
  ORDER BY version NULLS LAST, row_key) AS rn FROM typed),
merged AS (SELECT opp_id, {", ".join(
        f"arg_max({c}, rn) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _OPP_COLUMNS
    )} FROM ranked GROUP BY opp_id)""",
)
twin(
    "clean_accounts",
    f"""SELECT accountid AS account_id, {domain("domain__c")} AS domain,
  CASE {trim("billingcountry")} WHEN 'usa' THEN 'United States' WHEN 'UK' THEN 'United Kingdom'
    WHEN 'cote d''ivoire' THEN 'Cote D''Ivoire' WHEN 'guinea-bissau' THEN 'Guinea-Bissau' END AS country,
  CASE {trim(clean("industry"))} WHEN 'COMPUTER_SOFTWARE' THEN 'Software' WHEN 'It Services' THEN 'IT Services'
    WHEN 'E-Learning' THEN 'Education' ELSE {trim(clean("industry"))} END AS industry,
  round({number("annualrevenue")}, 2) AS annual_revenue,
  CASE WHEN account6qa6sense__c IN ('True', 'true') THEN true
    WHEN account6qa6sense__c IN ('False', 'false') THEN false END AS is_qualified,
  coalesce(nullif({clean("tier")}, 'TBD'), 'Unassigned') AS tier,
  coalesce({clean("segment__c")}, CASE WHEN {number("annualrevenue")} >= 500000000 THEN 'Enterprise'
    WHEN {number("annualrevenue")} >= 50000000 THEN 'Mid-Market'
    WHEN {number("annualrevenue")} IS NOT NULL THEN 'Commercial' END) AS segment
FROM raw_accounts""",
    "raw_accounts",
)
twin(
    "clean_campaign",
    f"""SELECT domain, campaign_id, spend, clicks, impressions, form_fills,
  epoch_us(d) AS activity_date, epoch_us(li) AS latest_impression, {month("d")} AS month_year,
  {div("clicks", "impressions", 6)} AS ctr, {div("spend", "clicks", 4)} AS cost_per_click,
  {div("spend", "form_fills", 4)} AS cost_per_form_fill
FROM typed""",
    "raw_campaign",
    more=f"""typed AS (SELECT {domain("_6sensedomain")} AS domain, _campaignid AS campaign_id,
  {number("_spend")} AS spend, {number("_clicks")} AS clicks, {number("_impressions")} AS impressions,
  CAST(coalesce({number("_influencedformfills")}, 0) AS BIGINT) AS form_fills,
  {when("_date")} AS d, {when("_latestimpression")} AS li FROM raw_campaign)""",
)
twin(
    "clean_ads",
    f"""SELECT epoch_us(d) AS activity_date, spend, clicks, impressions, views AS pageviews, platform,
  {div("clicks", "impressions", 6)} AS ctr, {div("spend", "impressions", 4, " * 1000")} AS cpm,
  {div("spend", "clicks", 4)} AS cpc, {div("views", "clicks", 6)} AS landing_cvr, {month("d")} AS month_year
FROM typed""",
    "raw_ads",
    more=f"""typed AS (SELECT {when("day")} AS d, {number("_spend")} AS spend, {number("_clicks")} AS clicks,
  {number("_impressions")} AS impressions, {number("pageviews")} AS views, trim(_platform) AS platform
FROM raw_ads)""",
)
twin(
    "clean_email",
    f"""SELECT epoch_us(ts) AS event_time, {domain("_domain")} AS domain,
  CASE {trim("_industry")} WHEN 'MEDIA_PRODUCTION' THEN 'Media' ELSE {trim("_industry")} END AS industry,
  trim(coalesce({clean("_seniority")}, 'Unknown')) AS seniority, _campaignID AS campaign_id,
  trim(replace(replace(_campaign_subject, chr(10), ' '), chr(13), ' ')) AS subject,
  coalesce(lower({clean("_engagement")}) = 'clicked', false) AS is_click,
  coalesce(lower({clean("_engagement")}) = 'opened', false) AS is_open,
  coalesce(lower({clean("_engagement")}) = 'register', false) AS is_register,
  CAST(floor((epoch_us(ts) - epoch_us(sent)) / 86400000000.0) AS BIGINT) AS days_to_engage,
  {month("ts")} AS month_year
FROM (SELECT *, {when("_timestamp")} AS ts, {when("_campaignSentDate")} AS sent FROM raw_email)""",
    "raw_email",
)
twin(
    "clean_web",
    f"""SELECT epoch_us(ts) AS event_time, {domain("_domain")} AS domain,
  {number("_totalsessionviews")} AS session_views,
  coalesce(src IN ('6sense', '6si_filtered', '6si'), false) AS is_display_traffic,
  coalesce(src IN ('hs_email', 'email', 'pardot'), false) AS is_email_traffic,
  coalesce(src LIKE '%linkedin%', false) AS is_social_traffic,
  coalesce(src IN ('organic', '(none)', 'google'), false) AS is_organic,
  CASE WHEN _goalcompletion IN ('True', 'true') THEN true
    WHEN _goalcompletion IN ('False', 'false') THEN false END AS is_goal_completed,
  {domain("_domain")} IS NOT NULL AS has_domain, {month("ts")} AS month_year
FROM (SELECT *, {when("_timestamp")} AS ts, lower(trim(_utmsource)) AS src FROM raw_web)""",
    "raw_web",
)
twin(
    "clean_contacts",
    f"""SELECT account_id, domain, seniority, lifecycle_stage, employees FROM (
  SELECT _sfdcaccountid AS account_id, {domain("_domain")} AS domain,
    trim(coalesce({clean("_seniority")}, 'Unknown')) AS seniority,
    CASE lower(trim(_lifecycleStage)) WHEN 'customer' THEN 'Customer' WHEN 'salesqualifiedlead' THEN 'SQL'
      ELSE _lifecycleStage END AS lifecycle_stage,
    {number("_employee")} AS employees FROM raw_contacts)
WHERE domain IS NULL OR domain NOT IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com', 'aol.com',
  'icloud.com', 'protonmail.com', 'live.com')""",
    "raw_contacts",
)
twin(
    "clean_segments",
    f"""SELECT {domain("_6sensedomain")} AS domain, epoch_us({when("_date")}) AS activity_date,
  {clean("_segment")} AS segment,
  CASE WHEN {clean("_segment")} IS NULL THEN 'Unknown' WHEN lower(_segment) LIKE '%why maas%' THEN 'Why MAAS'
    WHEN lower(_segment) LIKE '%intent%' THEN 'Intent'
    WHEN lower(_segment) LIKE '%named account%' THEN 'Named Accounts' ELSE 'Other' END AS segment_category,
  _6senseemployeerange AS employee_range
FROM raw_segments""",
    "raw_segments",
)
twin(
    "normalize_domain",
    """SELECT page_id, rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www[.]', ''),
  '/') AS domain FROM pages""",
)
_ONE_LINE = trim("replace(replace(text, chr(10), ' '), chr(13), ' ')")
twin(
    "clean_text",
    f"""SELECT doc_id, md5({_ONE_LINE}) AS text_hash, CAST(length({_ONE_LINE}) AS BIGINT) AS text_length,
  CASE WHEN contains(lower(text), 'the ') THEN 'The' WHEN contains(lower(text), 'und ') THEN 'Und'
    ELSE 'Other' END AS category
FROM documents""",
)

# --- integration -----------------------------------------------------------

_MASTER_TABLES = ("opps", "accounts", "campaign", "email", "web", "contacts", "segments")
_MASTER = """
s AS (SELECT domain, coalesce(string_agg(DISTINCT segment, '|' ORDER BY segment), '') AS segment_list,
    arg_min(segment_category, (activity_date, segment)) AS segment_category,
    arg_min(employee_range, (activity_date, segment)) FILTER (WHERE employee_range IS NOT NULL) AS emp_range,
    arg_min(revenue_range, (activity_date, segment)) AS rev_range
  FROM segments WHERE domain IS NOT NULL GROUP BY domain),
c AS (SELECT domain, round(sum(spend), 2) AS campaign_spend, sum(clicks) AS campaign_clicks,
    sum(impressions) AS campaign_impressions, CAST(sum(form_fills) AS BIGINT) AS campaign_form_fills
  FROM campaign WHERE domain IS NOT NULL GROUP BY domain),
e AS (SELECT domain, CAST(sum(CAST(is_open AS INT)) AS BIGINT) AS email_opens,
    CAST(sum(CAST(is_click AS INT)) AS BIGINT) AS email_clicks,
    CAST(sum(CAST(is_register AS INT)) AS BIGINT) AS email_registers,
    count(DISTINCT campaign_id) AS unique_email_campaigns
  FROM email WHERE domain IS NOT NULL GROUP BY domain),
w AS (SELECT domain, count(*) AS web_sessions, coalesce(sum(session_views), 0) AS web_pageviews,
    CAST(sum(CASE WHEN is_goal_completed THEN 1 ELSE 0 END) AS BIGINT) AS web_goal_completions
  FROM web WHERE domain IS NOT NULL GROUP BY domain),
o AS (SELECT account_id, round(coalesce(sum(amount), 0), 2) AS total_pipeline,
    round(coalesce(sum(amount) FILTER (WHERE is_won), 0), 2) AS total_won, count(opp_id) AS deal_count,
    arg_min(lead_source, opp_id) AS primary_leadsource, arg_min(channel_category, opp_id) AS channel_category,
    bool_or(is_marketing_sourced) AS is_marketing_sourced,
    arg_min(account_name, opp_id) FILTER (WHERE account_name IS NOT NULL) AS deal_account_name
  FROM opps GROUP BY account_id),
k AS (SELECT account_id, count(*) AS contact_count,
    count(*) FILTER (WHERE lower(seniority) = 'c-level') AS c_level_contacts,
    count(*) FILTER (WHERE lower(seniority) = 'vp') AS vp_contacts,
    count(*) FILTER (WHERE lower(seniority) = 'director') AS director_contacts,
    count(*) FILTER (WHERE lower(seniority) = 'manager') AS manager_contacts
  FROM contacts GROUP BY account_id),
base AS (
  SELECT account_id, account_name, domain, industry, tier, profile_fit, a.segment
  FROM accounts a
  UNION ALL
  SELECT account_id, deal_account_name, NULL, NULL, NULL, NULL, NULL
  FROM o WHERE account_id NOT IN (SELECT account_id FROM accounts)),
master AS (
  SELECT base.*, segment_list, segment_category, emp_range, rev_range, campaign_spend, campaign_clicks,
    campaign_impressions, campaign_form_fills, email_opens, email_clicks, email_registers,
    unique_email_campaigns, web_sessions, web_pageviews, web_goal_completions, total_pipeline, total_won,
    deal_count, primary_leadsource, channel_category, is_marketing_sourced, contact_count,
    c_level_contacts, vp_contacts, director_contacts, manager_contacts
  FROM base LEFT JOIN s USING (domain) LEFT JOIN c USING (domain) LEFT JOIN e USING (domain)
    LEFT JOIN w USING (domain) LEFT JOIN o USING (account_id) LEFT JOIN k USING (account_id))"""
for _name in ("account360", "account360_stored"):
    twin(
        _name,
        "SELECT * EXCLUDE (industry, tier, profile_fit, segment) FROM master",
        *_MASTER_TABLES,
        more=_MASTER,
    )
twin(
    "orphan_accounts",
    """SELECT account_id, round(coalesce(sum(amount), 0), 2) AS total_pipeline, count(*) AS deal_count,
  arg_min(account_name, opp_id) FILTER (WHERE account_name IS NOT NULL) AS account_name
FROM opps WHERE account_id NOT IN (SELECT account_id FROM accounts) GROUP BY account_id""",
    "opps",
    "accounts",
)

_CHANNELS = f"""
deal AS (SELECT channel_category, count(*) AS deal_count, coalesce(sum(amount), 0) AS total_pipeline,
    avg(amount) AS avg_deal_size, {n_if("is_won")} AS won_count,
    coalesce(sum(amount) FILTER (WHERE is_won), 0) AS won_pipeline FROM opps GROUP BY 1),
spent AS (SELECT CASE platform WHEN 'A' THEN '6sense_display' WHEN 'N' THEN 'email_mqa' ELSE 'web_inbound' END
    AS channel_category, sum(spend) AS channel_spend FROM ads GROUP BY 1),
channels AS (SELECT deal.*, {div("won_count", "deal_count", 4)} AS win_rate,
    {div("total_pipeline", "(SELECT sum(total_pipeline) FROM deal)", 4)} AS pipeline_pct,
    coalesce(channel_spend, 0.0) AS channel_spend,
    {div("total_pipeline", "channel_spend", 2)} AS pipeline_roi,
    {div("won_pipeline", "channel_spend", 2)} AS revenue_roi,
    {div("coalesce(channel_spend, 0.0)", "deal_count", 2)} AS cost_per_opp
  FROM deal LEFT JOIN spent USING (channel_category))"""
twin(
    "channel_pipeline",
    """SELECT channel_category, deal_count, round(total_pipeline, 2) AS total_pipeline,
  round(avg_deal_size, 2) AS avg_deal_size, won_count, round(won_pipeline, 2) AS won_pipeline, win_rate,
  pipeline_pct, round(channel_spend, 4) AS channel_spend, pipeline_roi, revenue_roi, cost_per_opp
FROM channels""",
    "opps",
    "ads",
    more=_CHANNELS,
)
twin("spend_by_platform", f"SELECT platform, {money('spend', 4)} AS spend FROM ads GROUP BY 1", "ads")
twin(
    "channel_roi_report",
    """SELECT channel_category AS channel, deal_count AS deals, round(total_pipeline, 2) AS total_pipeline,
  round(won_pipeline, 2) AS won_revenue, won_count AS won_deals, printf('%.1f%%', win_rate * 100) AS win_rate,
  round(avg_deal_size, 2) AS avg_deal_size, printf('%.1f%%', pipeline_pct * 100) AS pipeline_share,
  round(channel_spend, 4) AS channel_spend, pipeline_roi, revenue_roi, cost_per_opp,
  CASE WHEN total_pipeline >= 1e6 THEN printf('$%.1fM', total_pipeline / 1e6)
    WHEN total_pipeline >= 1e3 THEN printf('$%.0fK', total_pipeline / 1e3)
    ELSE printf('$%.0f', total_pipeline) END AS pipeline_text,
  CASE WHEN pipeline_roi IS NOT NULL THEN printf('%.1fx', pipeline_roi) END AS roi_text,
  CASE WHEN pipeline_roi > 5 THEN 'good' WHEN pipeline_roi < 2 AND pipeline_roi <> 0 THEN 'poor' ELSE '' END
    AS roi_band
FROM channels""",
    "opps",
    "ads",
    more=_CHANNELS,
)

_FUNNEL = f"""
stages AS (
  SELECT 1 AS stage_no, 'Impressions' AS stage, CAST(trunc((SELECT sum(impressions) FROM campaign)
    + (SELECT sum(impressions) FROM ads)) AS BIGINT) AS n
  UNION ALL SELECT 2, 'Clicks', CAST(trunc((SELECT sum(clicks) FROM campaign)
    + (SELECT sum(clicks) FROM ads)) AS BIGINT)
  UNION ALL SELECT 3, 'Form Fills / Goal Completions', CAST((SELECT sum(form_fills) FROM campaign)
    + (SELECT count(*) FROM web WHERE is_goal_completed) AS BIGINT)
  UNION ALL SELECT 4, 'Email Engagements', count(*) FROM email
  UNION ALL SELECT 5, 'Email Clicks', {n_if("is_click")} FROM email
  UNION ALL SELECT 6, 'All Opportunities', count(*) FROM opps
  UNION ALL SELECT 7, 'Marketing-Sourced Opps', {n_if("is_marketing_sourced")} FROM opps
  UNION ALL SELECT 8, 'Closed Won (All)', {n_if("is_won")} FROM opps
  UNION ALL SELECT 9, 'Marketing-Sourced Won', {n_if("is_marketing_sourced AND is_won")} FROM opps)"""
_FUNNEL_TABLES = ("campaign", "ads", "email", "web", "opps")
twin(
    "funnel_metrics",
    f"""SELECT 'All Channels' AS channel, CAST(stage_no AS BIGINT) AS stage_no, stage, n AS count,
  {div("n", "lag(n) OVER (ORDER BY stage_no)", 6)} AS conversion_from_prev,
  {div("n", "first_value(n) OVER (ORDER BY stage_no)", 6)} AS percent_of_initial
FROM stages""",
    *_FUNNEL_TABLES,
    more=_FUNNEL,
)

_CREATIVE_KEYS = "ad_name, platform, size, copy_messaging, copy_asset_type, copy_tone, cta_softness"
_CREATIVE = f"""
creative AS (SELECT ad_name, platform, size, copy_messaging,
    coalesce(copy_asset_type, 'Unknown') AS copy_asset_type, copy_tone, cta_softness,
    round(sum(spend), 4) AS spend, sum(clicks) AS clicks, sum(impressions) AS impressions,
    sum(pageviews) AS pageviews, {div("sum(clicks)", "sum(impressions)", 6)} AS ctr,
    {div("sum(spend)", "sum(impressions)", 4, " * 1000")} AS cpm,
    {div("sum(spend)", "sum(clicks)", 4)} AS cpc, {div("sum(pageviews)", "sum(clicks)", 4)} AS landing_cvr
  FROM ads GROUP BY ALL)"""
twin("creative_performance", "SELECT * FROM creative", "ads", more=_CREATIVE)
twin(
    "top_creatives",
    f"SELECT * FROM creative ORDER BY ctr DESC NULLS LAST, impressions DESC, {_CREATIVE_KEYS} LIMIT 20",
    "ads",
    more=_CREATIVE,
)
_ATTRIBUTES = ["copy_messaging", "copy_asset_type", "copy_tone", "cta_softness", "size"]
twin(
    "creative_by_attribute",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, coalesce({a}, 'Unknown') AS value, sum(impressions) AS impressions,
  sum(clicks) AS clicks, round(sum(spend), 4) AS spend, {div("sum(clicks)", "sum(impressions)", 6)} AS ctr,
  {div("sum(spend)", "sum(clicks)", 2)} AS cpc FROM ads GROUP BY 2"""
        for a in _ATTRIBUTES
    ),
    "ads",
)
twin(
    "creative_by_platform",
    f"""SELECT platform, round(sum(spend), 4) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks,
  {div("sum(clicks)", "sum(impressions)", 6)} AS ctr,
  {div("sum(spend)", "sum(impressions)", 2, " * 1000")} AS cpm FROM ads GROUP BY 1""",
    "ads",
)

# --- reports ---------------------------------------------------------------


def summary(keys: str, source: str, rate: int, where: str = "true", drop: tuple[str, ...] = ()) -> str:
    parts = {
        "deals": "count(opp_id)",
        "won": n_if("is_won"),
        "pipeline": money("amount"),
        "won_pipeline": "round(coalesce(sum(amount) FILTER (WHERE is_won), 0), 2)",
        "avg_deal": "round(avg(amount), 2)",
        "win_rate": div(n_if("is_won"), "count(opp_id)", rate),
    }
    chosen = ", ".join(f"{e} AS {c}" for c, e in parts.items() if c not in drop)
    not_null = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"SELECT {keys}, {chosen} FROM {source} WHERE {not_null} AND {where} GROUP BY {keys}"


twin("segment_conversion", summary("segment", "opps", 4), "opps")
twin(
    "deals_by_channel_segment", summary("channel_category, segment", "opps", 6), "opps"
)
twin(
    "industry_pipeline",
    f"""SELECT industry, count(account_id) AS accounts, {money("total_pipeline")} AS pipeline FROM master
WHERE industry IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""",
    *_MASTER_TABLES,
    more=_MASTER,
)
twin(
    "contacts_seniority_stage",
    """SELECT seniority, lifecycle_stage, false AS is_total, count(*) AS contacts FROM contacts
WHERE lifecycle_stage IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT seniority, NULL, true, count(*) FROM contacts GROUP BY 1""",
    "contacts",
)
twin("contacts_by_seniority", "SELECT seniority, count(*) AS contacts FROM contacts GROUP BY 1", "contacts")


def rates(key: str, digits: int, extra: str = "") -> str:
    head = f"{key}, " if key else ""
    tail = f"WHERE {key} IS NOT NULL GROUP BY {key}" if key else ""
    return f"""SELECT {head}count(*) AS events, {n_if("is_open")} AS opens, {n_if("is_click")} AS clicks,
  {n_if("is_register")} AS registers, {extra}
  {div(n_if("is_open"), "count(*)", digits)} AS open_rate,
  {div(n_if("is_click"), "count(*)", digits)} AS click_rate,
  {div(n_if("is_register"), "count(*)", digits)} AS register_rate,
  {div(n_if("is_click"), n_if("is_open"), digits)} AS click_to_open FROM email {tail}"""


twin(
    "email_by_campaign",
    rates(
        "campaign_id",
        4,
        "arg_min(subject, (event_time, subject)) FILTER (WHERE subject IS NOT NULL) AS subject,",
    ),
    "email",
)
twin("email_by_seniority", rates("seniority", 4), "email")
twin(
    "email_by_industry",
    rates("industry", 4) + " ORDER BY click_rate DESC NULLS LAST, industry LIMIT 20",
    "email",
)
twin("email_by_quarter", rates("quarter_segment", 4), "email")
twin("email_kpis", rates("", 6), "email")

_SCENARIOS = f"""
ranked AS (SELECT channel_category, channel_spend, total_pipeline / channel_spend AS ppd,
    channel_spend / sum(channel_spend) OVER () AS spend_share,
    row_number() OVER (ORDER BY pipeline_roi DESC, channel_category) <= 2 AS is_top,
    row_number() OVER (ORDER BY pipeline_roi, channel_category DESC) <= 2 AS is_bottom,
    channel_category IN ('email_mqa', '6sense_display') AS grows
  FROM channels WHERE channel_spend > 0),
scenarios AS (
  SELECT 1 AS scenario_no, 'Status Quo' AS scenario, *, channel_spend AS spend FROM ranked
  UNION ALL SELECT 2, 'ROI-Optimized', *, channel_spend * CASE WHEN is_top THEN 1.3 ELSE 1.0 END
    * CASE WHEN is_bottom THEN 0.8 ELSE 1.0 END FROM ranked
  UNION ALL SELECT 3, 'Growth Mode', *, channel_spend * CASE WHEN grows THEN 2.0 ELSE 1.0 END
    * CASE WHEN is_bottom THEN 0.5 ELSE 1.0 END FROM ranked)"""
twin(
    "budget_scenarios",
    """SELECT CAST(scenario_no AS BIGINT) AS scenario_no, scenario, channel_category,
  round(channel_spend, 4) AS current_spend, round(spend_share, 6) AS spend_share, round(spend, 4) AS spend,
  round(ppd, 6) AS pipeline_per_dollar, round(spend * ppd, 2) AS projected_pipeline,
  round((spend - channel_spend) / channel_spend, 6) AS change FROM scenarios""",
    "opps",
    "ads",
    more=_CHANNELS + "," + _SCENARIOS,
)
twin(
    "budget_totals",
    """SELECT CAST(scenario_no AS BIGINT) AS scenario_no, scenario, round(sum(spend), 2) AS spend,
  round(sum(spend * ppd), 2) AS projected_pipeline,
  round(sum(spend * ppd) - (SELECT sum(spend * ppd) FROM scenarios WHERE scenario_no = 1), 2) AS gain
FROM scenarios GROUP BY 1, 2""",
    "opps",
    "ads",
    more=_CHANNELS + "," + _SCENARIOS,
)

# --- touches and attribution -----------------------------------------------

_TOUCH_TABLES = ("campaign", "email", "web")
_LOGGED = """
logged AS (
  SELECT domain, coalesce(latest_impression, activity_date) AS touch_date, '6sense_display' AS channel,
    'ad_impression' AS touch_type, campaign_id FROM campaign
  UNION ALL
  SELECT domain, event_time, 'email_mqa', CASE WHEN is_click THEN 'email_click'
    WHEN is_register THEN 'email_register' ELSE 'email_open' END, campaign_id FROM email)"""
_TOUCHES = (
    _LOGGED
    + """,
touches AS (
  SELECT * FROM logged
  UNION ALL
  SELECT domain, event_time,
    CASE utm_source WHEN '6si' THEN '6sense_display' WHEN '6sense-ads' THEN '6sense_display'
      WHEN 'HS_Email' THEN 'email_mqa' WHEN 'linkedin_ads' THEN 'linkedin' ELSE 'web_inbound' END,
    CASE utm_source WHEN '6si' THEN 'web_visit_6sense' WHEN '6sense-ads' THEN 'web_visit_6sense'
      WHEN 'HS_Email' THEN 'web_visit_email' WHEN 'linkedin_ads' THEN 'web_visit_linkedin'
      WHEN 'google' THEN 'web_visit_organic' ELSE 'web_visit_other' END, utm_campaign
  FROM web WHERE domain IS NOT NULL)"""
)
_RESOLVED = """
resolved AS (SELECT deals.* EXCLUDE (domain), coalesce(CASE WHEN deals.domain IS NOT NULL
    THEN 'acct' || deals.account_id || '.com' END, accounts.domain) AS domain
  FROM deals LEFT JOIN accounts USING (account_id))"""
_LINKED = f"""
linked AS (SELECT r.*, t.touch_date, t.channel, t.touch_type, t.campaign_id,
    (epoch_us(create_date) - epoch_us(touch_date)) / 86400000000.0 AS days_before
  FROM resolved r JOIN touches t ON r.domain = t.domain
    AND t.touch_date BETWEEN r.create_date - INTERVAL {B.WINDOW_DAYS} DAYS AND r.create_date
  WHERE amount IS NOT NULL)"""


def at_defaults(sql: str) -> str:
    """The same at a window of 365 days and a half-life of 30."""
    return sql.replace(f"INTERVAL {B.WINDOW_DAYS} DAYS", "INTERVAL 365 DAYS").replace(
        f"-days_before / {B.HALF_LIFE}.0", "-days_before / 30.0"
    )


_LINK_TABLES = ("deals", "accounts", *_TOUCH_TABLES)
_LINK_MORE = ",".join([_TOUCHES, _RESOLVED, _LINKED])

twin(
    "touchpoints",
    "SELECT domain, epoch_us(touch_date) AS touch_date, channel, touch_type, campaign_id FROM touches",
    *_TOUCH_TABLES,
    more=_TOUCHES,
)
twin(
    "touch_summary",
    """SELECT channel, touch_type, count(*) AS touches, count(DISTINCT domain) AS domains,
  epoch_us(min(touch_date)) AS first_touch, epoch_us(max(touch_date)) AS last_touch FROM touches GROUP BY 1, 2""",
    *_TOUCH_TABLES,
    more=_TOUCHES,
)
twin(
    "linked_touches",
    """SELECT opp_id, domain, epoch_us(create_date) AS create_date, amount, channel_category,
  is_marketing_sourced, is_won, epoch_us(touch_date) AS touch_date, channel, touch_type, campaign_id,
  round(days_before, 6) AS days_before FROM linked""",
    *_LINK_TABLES,
    more=_LINK_MORE,
)
twin(
    "touch_intervals",
    f"""SELECT opp_id, domain, epoch_us(create_date) AS create_date, first, after, after - first AS touches
FROM (SELECT r.opp_id, r.domain, r.create_date,
    count(*) FILTER (WHERE t.touch_date < r.create_date - INTERVAL {B.WINDOW_DAYS} DAYS) AS first,
    count(*) FILTER (WHERE t.touch_date <= r.create_date) AS after
  FROM resolved r LEFT JOIN touches t ON r.domain = t.domain
  WHERE amount IS NOT NULL AND create_date IS NOT NULL AND r.domain IS NOT NULL GROUP BY 1, 2, 3)""",
    *_LINK_TABLES,
    more=_LINK_MORE,
)
twin(
    "numbered_touches",
    """SELECT domain, count(*) AS touches, 0::BIGINT AS lowest, count(*) - 1 AS highest,
  epoch_us(min(touch_date)) AS first_us, epoch_us(max(touch_date)) AS last_us
FROM touches WHERE domain IS NOT NULL AND touch_date IS NOT NULL GROUP BY domain""",
    *_TOUCH_TABLES,
    more=_TOUCHES,
)
_WEIGHT = f"pow(2.0, -days_before / {B.HALF_LIFE}.0)"
twin(
    "deal_channel_links",
    f"""SELECT opp_id, channel, count(*) AS touches, epoch_us(min(touch_date)) AS first_us,
  epoch_us(max(touch_date)) AS last_us, round(sum({_WEIGHT}), 6) AS weight FROM linked GROUP BY 1, 2""",
    *_LINK_TABLES,
    more=_LINK_MORE,
)
twin(
    "deal_touch_links",
    f"""SELECT opp_id, channel, touch_type, campaign_id, count(*) AS touches,
  epoch_us(min(touch_date)) AS first_us, epoch_us(max(touch_date)) AS last_us, round(sum({_WEIGHT}), 6) AS weight
FROM linked GROUP BY 1, 2, 3, 4""",
    *_LINK_TABLES,
    more=_LINK_MORE,
)
twin(
    "deal_channel_links_default",
    at_defaults(f"""SELECT opp_id, channel, count(*) AS touches, epoch_us(min(touch_date)) AS first_us,
  epoch_us(max(touch_date)) AS last_us, round(sum({_WEIGHT}), 6) AS weight FROM linked GROUP BY 1, 2"""),
    *_LINK_TABLES,
    more=at_defaults(_LINK_MORE),
)
_CREDIT = "sum(credit) AS p, coalesce(sum(credit) FILTER (WHERE is_won), 0) AS w, count(*) AS n"
_MODELS = f"""
m_sourced AS (SELECT 'Marketing Sourced' AS m, channel_category AS channel, coalesce(sum(amount), 0) AS p,
    coalesce(sum(amount) FILTER (WHERE is_won), 0) AS w, count(*) AS n
  FROM deals WHERE is_marketing_sourced GROUP BY 2),
m_influenced AS (SELECT 'Marketing Influenced' AS m, channel_category AS channel, sum(amount) AS p,
    coalesce(sum(amount) FILTER (WHERE is_won), 0) AS w, count(*) AS n
  FROM deals WHERE opp_id IN (SELECT opp_id FROM linked) GROUP BY 2),
firsts AS (SELECT *, amount AS credit FROM linked
  QUALIFY row_number() OVER (PARTITION BY opp_id ORDER BY touch_date, channel) = 1),
m_first AS (SELECT 'First-Touch' AS m, channel, {_CREDIT} FROM firsts GROUP BY 2),
lasts AS (SELECT *, amount AS credit FROM linked
  QUALIFY row_number() OVER (PARTITION BY opp_id ORDER BY touch_date DESC, channel DESC) = 1),
m_last AS (SELECT 'Last-Touch' AS m, channel, {_CREDIT} FROM lasts GROUP BY 2),
per_channel AS (SELECT opp_id, channel, any_value(amount) AS amount, any_value(is_won) AS is_won,
    sum({_WEIGHT}) AS weight FROM linked GROUP BY 1, 2),
linear AS (SELECT *, amount / count(*) OVER (PARTITION BY opp_id) AS credit FROM per_channel),
m_linear AS (SELECT 'Linear' AS m, channel, {_CREDIT} FROM linear GROUP BY 2),
decayed AS (SELECT *, amount * weight / sum(weight) OVER (PARTITION BY opp_id) AS credit FROM per_channel),
m_decay AS (SELECT 'Time-Decay' AS m, channel, {_CREDIT} FROM decayed GROUP BY 2),
results AS (SELECT * FROM m_sourced UNION ALL SELECT * FROM m_influenced UNION ALL SELECT * FROM m_first
  UNION ALL SELECT * FROM m_last UNION ALL SELECT * FROM m_linear UNION ALL SELECT * FROM m_decay)"""
_MODEL_MORE = _LINK_MORE + "," + _MODELS
_SHOWN = """SELECT m AS attribution_model, channel, round(p, 4) AS attributed_pipeline,
  round(w, 4) AS attributed_won, n AS deal_count FROM results"""
for _name, _model in {
    "attr_sourced": "Marketing Sourced",
    "attr_influenced": "Marketing Influenced",
    "attr_first": "First-Touch",
    "attr_last": "Last-Touch",
    "attr_linear": "Linear",
    "attr_time_decay": "Time-Decay",
}.items():
    twin(_name, f"{_SHOWN} WHERE m = '{_model}'", *_LINK_TABLES, more=_MODEL_MORE)
twin("attr_all_models", _SHOWN, *_LINK_TABLES, more=_MODEL_MORE)
twin("attr_all_models_default", _SHOWN, *_LINK_TABLES, more=at_defaults(_MODEL_MORE))
_WIDE = """
wide AS (SELECT channel, coalesce(sum(p) FILTER (WHERE m = 'Marketing Sourced'), 0) AS marketing_sourced,
    coalesce(sum(p) FILTER (WHERE m = 'Marketing Influenced'), 0) AS marketing_influenced,
    coalesce(sum(p) FILTER (WHERE m = 'First-Touch'), 0) AS first_touch,
    coalesce(sum(p) FILTER (WHERE m = 'Last-Touch'), 0) AS last_touch,
    coalesce(sum(p) FILTER (WHERE m = 'Linear'), 0) AS linear_,
    coalesce(sum(p) FILTER (WHERE m = 'Time-Decay'), 0) AS time_decay
  FROM results GROUP BY 1)"""
twin(
    "attr_comparison",
    """SELECT channel, round(marketing_sourced, 4) AS marketing_sourced,
  round(marketing_influenced, 4) AS marketing_influenced, round(first_touch, 4) AS first_touch,
  round(last_touch, 4) AS last_touch, round(linear_, 4) AS linear, round(time_decay, 4) AS time_decay FROM wide""",
    *_LINK_TABLES,
    more=_MODEL_MORE + "," + _WIDE,
)
twin(
    "attr_shift",
    """SELECT channel, round(first_touch, 4) AS before, round(last_touch, 4) AS after,
  round(last_touch - first_touch, 2) AS shift FROM wide
WHERE channel IN (SELECT channel FROM results WHERE m IN ('First-Touch', 'Last-Touch'))""",
    *_LINK_TABLES,
    more=_MODEL_MORE + "," + _WIDE,
)
twin(
    "attr_best_model",
    """SELECT channel, CASE WHEN time_decay > first_touch AND time_decay > last_touch AND time_decay > linear_
    THEN 'Time-Decay' WHEN linear_ > first_touch AND linear_ > last_touch THEN 'Linear'
    WHEN last_touch > first_touch THEN 'Last-Touch' ELSE 'First-Touch' END AS best_model FROM wide""",
    *_LINK_TABLES,
    more=_MODEL_MORE + "," + _WIDE,
)
twin(
    "attr_report",
    """SELECT m AS attribution_model, channel, format('${:,}', CAST(round(p) AS BIGINT)) AS attributed_pipeline,
  format('${:,}', CAST(round(w) AS BIGINT)) AS attributed_won, n AS deal_count FROM results""",
    *_LINK_TABLES,
    more=_MODEL_MORE,
)
twin(
    "sourced_vs_influenced",
    """SELECT round(total, 2) AS total_pipeline, round(s, 2) AS sourced, round(i, 2) AS influenced,
  round(greatest(total - s, 0), 2) AS not_sourced, round(greatest(total - i, 0), 2) AS not_influenced
FROM (SELECT (SELECT sum(amount) FROM deals) AS total,
  (SELECT sum(p) FROM results WHERE m = 'Marketing Sourced') AS s,
  (SELECT sum(p) FROM results WHERE m = 'Marketing Influenced') AS i)""",
    *_LINK_TABLES,
    more=_MODEL_MORE,
)

# --- advanced --------------------------------------------------------------

_COVERED = """
covered AS (SELECT domain, domain IN (SELECT domain FROM reached_email) AS in_email,
    domain IN (SELECT lower(trim(domain)) FROM reached_display) AS in_display,
    domain IN (SELECT domain FROM opps WHERE domain IS NOT NULL) AS has_opportunity
  FROM (SELECT DISTINCT domain FROM accounts WHERE domain IS NOT NULL)),
tiered AS (SELECT *, CAST(in_email AS INT) + CAST(in_display AS INT) AS reached,
    CASE WHEN in_email AND in_display THEN 1 WHEN in_email THEN 2 WHEN in_display THEN 3 ELSE 4 END AS tier_no,
    CASE WHEN in_email AND in_display THEN 'Both Channels' WHEN in_email THEN 'Email Only'
      WHEN in_display THEN '6sense Only' ELSE 'Not Reached' END AS coverage_tier FROM covered)"""
_COVER_TABLES = ("accounts", "reached_email", "reached_display", "opps")
for _name in ("coverage_accounts", "coverage_accounts_marks"):
    twin(
        _name,
        """SELECT domain, in_email, in_display, has_opportunity, CAST(reached AS BIGINT) AS reached_count,
  coverage_tier FROM tiered""",
        *_COVER_TABLES,
        more=_COVERED,
    )
twin(
    "segment_sets",
    """SELECT domain, string_agg(DISTINCT segment, '|' ORDER BY segment) AS segments,
  count(DISTINCT segment) AS n_segments
FROM segments WHERE domain IS NOT NULL AND segment IS NOT NULL GROUP BY domain""",
    "segments",
)
_NAMED = """,
named AS (SELECT domain, channel, concat_ws('/', channel, touch_type, campaign_id) AS campaign FROM touches)"""
twin(
    "campaign_sets",
    """SELECT domain, string_agg(DISTINCT campaign, '|' ORDER BY campaign) AS campaigns,
  count(DISTINCT campaign) AS n_campaigns FROM named WHERE domain IS NOT NULL GROUP BY domain""",
    *_TOUCH_TABLES,
    more=_TOUCHES + _NAMED,
)
twin(
    "channel_combinations",
    """SELECT channels, n_channels, count(*) AS domains
FROM (SELECT domain, string_agg(DISTINCT channel, '|' ORDER BY channel) AS channels,
    count(DISTINCT channel) AS n_channels FROM named WHERE domain IS NOT NULL GROUP BY domain) GROUP BY 1, 2""",
    *_TOUCH_TABLES,
    more=_TOUCHES + _NAMED,
)


def _any(channels: list[str]) -> str:
    return "coalesce(bool_or(channel IN ({})), false)".format(", ".join(f"'{c}'" for c in channels))


twin(
    "channel_audience",
    f"""SELECT domain FROM named WHERE domain IS NOT NULL GROUP BY domain
HAVING {" AND ".join(_any([c]) for c in B.AUDIENCE["all_of"])} AND {_any(B.AUDIENCE["any_of"])}
  AND NOT {_any(B.AUDIENCE["none_of"])}""",
    *_TOUCH_TABLES,
    more=_TOUCHES + _NAMED,
)
twin(
    "coverage_summary",
    f"""SELECT CAST(tier_no AS BIGINT) AS tier_no, coverage_tier, count(*) AS accounts,
  {n_if("has_opportunity")} AS with_opp,
  round(count(*) / CAST((SELECT count(*) FROM tiered) AS DOUBLE), 6) AS pct_of_total,
  {div(n_if("has_opportunity"), "count(*)", 6)} AS opp_rate FROM tiered GROUP BY 1, 2""",
    *_COVER_TABLES,
    more=_COVERED,
)
_TIMED = """
timed AS (SELECT *, CAST(floor((epoch_us(close_date) - epoch_us(create_date)) / 86400000000.0) AS BIGINT) AS d
  FROM opps JOIN closings USING (opp_id) WHERE is_won)"""
twin(
    "velocity_channel",
    """SELECT channel_category, round(avg(d), 6) AS mean_days, quantile_cont(d, 0.5) AS median_days,
  count(*) AS deal_count, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.75) AS p75
FROM timed WHERE d BETWEEN 1 AND 730 GROUP BY 1""",
    "opps",
    "closings",
    more=_TIMED,
)
twin(
    "velocity_segment",
    """SELECT segment, round(avg(d), 6) AS mean_days, quantile_cont(d, 0.5) AS median_days,
  count(*) AS deal_count FROM timed WHERE d BETWEEN 1 AND 730 AND segment IS NOT NULL GROUP BY 1""",
    "opps",
    "closings",
    more=_TIMED,
)
_JOURNEYS = """
seen AS (SELECT r.opp_id, r.amount, t.channel, t.touch_date,
    lag(t.channel) OVER (PARTITION BY r.opp_id ORDER BY t.touch_date, t.channel) AS before
  FROM (SELECT * EXCLUDE (domain), 'acct' || account_id || '.com' AS domain FROM deals WHERE domain IS NOT NULL) r
  JOIN logged t ON r.domain = t.domain AND t.touch_date <= r.create_date WHERE is_won),
counted AS (SELECT opp_id, any_value(amount) AS amount, count(*) AS n_touches,
    count(DISTINCT channel) AS n_channels,
    arg_max(channel, (touch_date, channel)) AS last_channel FROM seen GROUP BY 1),
steps AS (SELECT opp_id, channel, touch_date,
    row_number() OVER (PARTITION BY opp_id ORDER BY touch_date, channel) AS step
  FROM seen WHERE before IS NULL OR before <> channel),
paths AS (SELECT opp_id, string_agg(channel, ' -> ' ORDER BY step) FILTER (WHERE step <= 5) AS sequence,
    string_agg(channel, ' -> ' ORDER BY step) FILTER (WHERE step <= 2) AS sequence_2ch,
    any_value(channel) FILTER (WHERE step = 1) AS first_channel FROM steps GROUP BY 1),
journey AS (SELECT opp_id, amount, n_touches, n_channels, first_channel, last_channel, sequence, sequence_2ch
  FROM counted JOIN paths USING (opp_id))"""
_JOURNEY_TABLES = ("deals", "campaign", "email")
_JOURNEY_MORE = ",".join([_LOGGED, _JOURNEYS])
twin("journeys", "SELECT * FROM journey", *_JOURNEY_TABLES, more=_JOURNEY_MORE)
twin(
    "journey_top_sequences",
    f"""SELECT sequence_2ch, count(*) AS deals, {money("amount")} AS pipeline FROM journey GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
    *_JOURNEY_TABLES,
    more=_JOURNEY_MORE,
)
twin(
    "journey_first_channel",
    "SELECT first_channel, count(*) AS deals FROM journey GROUP BY 1",
    *_JOURNEY_TABLES,
    more=_JOURNEY_MORE,
)
_JOINED = """
joined AS (SELECT opps.*, is_qualified, profile_fit FROM opps
  JOIN accounts USING (account_id))"""
_NO_WON = ("won_pipeline",)
twin(
    "qualified_performance", summary("is_qualified", "joined", 6), "opps", "accounts", more=_JOINED
)
twin(
    "profile_fit_performance",
    summary("profile_fit", "joined", 6, drop=_NO_WON),
    "opps",
    "accounts",
    more=_JOINED,
)
_MATRIX = """
matrix AS (SELECT segment, profile_fit, count(opp_id) AS deals, count(*) FILTER (WHERE is_won) AS won,
    coalesce(sum(amount), 0) AS pipeline, avg(amount) AS avg_deal,
    count(*) FILTER (WHERE is_won) / CAST(count(opp_id) AS DOUBLE) AS win_rate
  FROM joined WHERE segment IS NOT NULL AND profile_fit IS NOT NULL GROUP BY 1, 2)"""
twin(
    "targeting_matrix",
    """SELECT segment, profile_fit, deals, won, round(pipeline, 2) AS pipeline, round(avg_deal, 2) AS avg_deal,
  round(win_rate, 6) AS win_rate, round(win_rate * avg_deal / 1000, 4) AS priority_score FROM matrix""",
    "opps",
    "accounts",
    more=_JOINED + "," + _MATRIX,
)
twin(
    "targeting_pivot",
    """SELECT segment, round(coalesce(avg(win_rate) FILTER (WHERE profile_fit = 'Strong'), 0), 6) AS strong,
  round(coalesce(avg(win_rate) FILTER (WHERE profile_fit = 'Moderate'), 0), 6) AS moderate,
  round(coalesce(avg(win_rate) FILTER (WHERE profile_fit NOT IN ('Strong', 'Moderate')), 0), 6) AS other
FROM matrix GROUP BY 1""",
    "opps",
    "accounts",
    more=_JOINED + "," + _MATRIX,
)
twin(
    "cohort_quarterly",
    f"""SELECT year(create_date) || 'Q' || quarter(create_date) AS quarter, count(opp_id) AS deals,
  {n_if("is_won")} AS won, {money("amount")} AS pipeline,
  round(coalesce(sum(amount) FILTER (WHERE is_won), 0), 2) AS won_pipeline, round(avg(amount), 2) AS avg_deal,
  {n_if("is_marketing_sourced")} AS marketing_sourced, {div(n_if("is_won"), "count(*)", 6)} AS win_rate,
  {div(n_if("is_marketing_sourced"), "count(*)", 6)} AS marketing_share
FROM opps WHERE amount IS NOT NULL GROUP BY 1""",
    "opps",
)

twin(
    "cohort_last",
    f"""SELECT year(create_date) || 'Q' || quarter(create_date) AS quarter, count(opp_id) AS deals,
  {n_if("is_won")} AS won, {money("amount")} AS pipeline,
  round(coalesce(sum(amount) FILTER (WHERE is_won), 0), 2) AS won_pipeline, round(avg(amount), 2) AS avg_deal,
  {n_if("is_marketing_sourced")} AS marketing_sourced, {div(n_if("is_won"), "count(*)", 6)} AS win_rate,
  {div(n_if("is_marketing_sourced"), "count(*)", 6)} AS marketing_share
FROM opps WHERE amount IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 4""",
    "opps",
)
twin(
    "winning_channels",
    """SELECT channel_category, round(won_pipeline, 2) AS won_pipeline, round(win_rate, 6) AS win_rate,
  round(coalesce(win_rate, 0) * 100, 6) AS win_percent FROM channels WHERE won_pipeline > 0""",
    "opps",
    "ads",
    more=_CHANNELS,
)
twin(
    "attr_channels_above",
    "SELECT channel, round(sum(p), 4) AS attributed_pipeline FROM results GROUP BY 1 HAVING sum(p) > 1000",
    *_LINK_TABLES,
    more=_MODEL_MORE,
)
twin("raw_exports", "SELECT * FROM raw_campaign", "raw_campaign")
_TYPED_CELLS = {
    "opportunities": {"version": ("_order", "double"), "amount": ("_amount", "double"),
        "create_date": ("_createdate", "timestamp"), "is_won": ("iswon", "boolean")},
    "accounts": {"annual_revenue": ("annualrevenue", "double"), "is_qualified": ("account6qa6sense__c", "boolean")},
    "campaign": {"spend": ("_spend", "double"), "clicks": ("_clicks", "double"), "impressions": ("_impressions", "double"),
        "form_fills": ("_influencedformfills", "bigint"), "activity_date": ("_date", "timestamp"),
        "latest_impression": ("_latestimpression", "timestamp")},
    "ads": {"activity_date": ("day", "timestamp"), "spend": ("_spend", "double"), "clicks": ("_clicks", "double"),
        "impressions": ("_impressions", "double"), "pageviews": ("pageviews", "double")},
    "email": {"event_time": ("_timestamp", "timestamp"), "sent_date": ("_campaignSentDate", "timestamp")},
    "web": {"event_time": ("_timestamp", "timestamp"), "session_views": ("_totalsessionviews", "double"),
        "is_goal_completed": ("_goalcompletion", "boolean")},
    "contacts": {"employees": ("_employee", "double")},
    "segments": {"activity_date": ("_date", "timestamp")},
}
_FLAGS = ", ".join(f"'{x}'" for x in (*V.TRUE_TOKENS, *V.FALSE_TOKENS))
_READ = {
    "double": number,
    "bigint": number,
    "timestamp": when,
    "boolean": lambda c: f"CASE WHEN {clean(c)} IN ({_FLAGS}) THEN 1 END",
}
twin(
    "rejected_cells",
    " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{name}' AS "column", '{kind}' AS type, count(*) AS rows,
  count({clean(raw)}) AS filled, count(*) FILTER (WHERE {clean(raw)} IS NOT NULL AND {_READ[kind](raw)} IS NULL) AS rejected
FROM raw_{table}"""
        for table, columns in _TYPED_CELLS.items()
        for name, (raw, kind) in columns.items()
    ),
    *(f"raw_{table}" for table in _TYPED_CELLS),
)
twin(
    "malformed_lines",
    """SELECT count(*) AS lines, count(*) FILTER (WHERE cells <> 4) AS malformed,
  count(*) FILTER (WHERE _6sensedomain = '') AS unnamed
FROM (SELECT *, CAST(_6sensedomain IS NOT NULL AS INT) + CAST(_spend IS NOT NULL AS INT) + CAST(_clicks IS NOT NULL AS INT)
    + CAST(coalesce(_clicks <> '2', false) AND _date IS NOT NULL AS INT)
    + CAST(coalesce(_spend = 'null', false) AS INT) AS cells FROM raw_campaign)""",
    "raw_campaign",
)
twin(
    "touches_without_web",
    """SELECT channel, touch_type, count(*) AS touches, count(DISTINCT domain) AS domains,
  epoch_us(min(touch_date)) AS first_touch, epoch_us(max(touch_date)) AS last_touch FROM logged GROUP BY 1, 2""",
    "campaign",
    "email",
    more=_LOGGED,
)
twin(
    "stored_tables",
    f"""SELECT {month("activity_date")} AS month, count(*) AS rows, sum(impressions) AS impressions,
  {money("spend")} AS spend FROM campaign GROUP BY 1""",
    "campaign",
)

# --- dashboards ------------------------------------------------------------

twin(
    "monthly_pipeline",
    f"""SELECT {month("create_date")} AS month, channel_category, {money("amount")} AS pipeline
FROM opps GROUP BY 1, 2""",
    "opps",
)
twin(
    "monthly_campaign",
    f"SELECT month_year, {money('spend')} AS spend, sum(impressions) AS impressions FROM campaign GROUP BY 1",
    "campaign",
)
twin(
    "kpis",
    f"""SELECT {money("amount")} AS total_pipeline,
  round(coalesce(sum(amount) FILTER (WHERE is_won), 0), 2) AS won_pipeline,
  round(coalesce(sum(amount) FILTER (WHERE is_marketing_sourced), 0), 2) AS marketing_pipeline,
  count(*) AS deals, {n_if("is_won")} AS won_deals, {div(n_if("is_won"), "count(*)", 6)} AS win_rate,
  round(sum(amount) FILTER (WHERE is_marketing_sourced) / sum(amount), 6) AS marketing_share FROM opps""",
    "opps",
)
twin(
    "campaign_kpis",
    f"""SELECT {money("spend")} AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks,
  CAST(sum(form_fills) AS BIGINT) AS form_fills, {div("sum(clicks)", "sum(impressions)", 6)} AS ctr,
  {div("sum(spend)", "sum(form_fills)", 6)} AS cost_per_fill FROM campaign""",
    "campaign",
)
twin(
    "web_kpis",
    f"""SELECT count(*) AS sessions, {n_if("is_goal_completed")} AS goals, {n_if("has_domain")} AS identified,
  {n_if("is_display_traffic")} AS display_sessions FROM web""",
    "web",
)
twin(
    "traffic_mix",
    f"""SELECT * FROM (
  SELECT '6sense Display' AS traffic_source, {n_if("is_display_traffic")} AS sessions FROM web
  UNION ALL SELECT 'Email', {n_if("is_email_traffic")} FROM web
  UNION ALL SELECT 'LinkedIn', {n_if("is_social_traffic")} FROM web
  UNION ALL SELECT 'Organic', {n_if("is_organic")} FROM web
  UNION ALL SELECT 'Other/Direct', greatest(0, count(*) - {n_if("is_display_traffic")}
    - {n_if("is_email_traffic")} - {n_if("is_social_traffic")} - {n_if("is_organic")}) FROM web)
WHERE sessions > 0""",
    "web",
)
twin(
    "open_by_stage",
    f"""SELECT stage, count(stage) AS deals, {money("amount")} AS pipeline FROM opps
WHERE NOT coalesce(is_won, false) AND amount IS NOT NULL AND stage IS NOT NULL
GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""",
    "opps",
)
twin(
    "pipeline_by_segment",
    f"""SELECT segment, {money("amount")} AS pipeline FROM opps
WHERE segment IS NOT NULL AND amount IS NOT NULL GROUP BY 1""",
    "opps",
)
twin(
    "lost_reasons",
    """SELECT lost_reason, count(*) AS deals FROM opps WHERE lost_reason IS NOT NULL GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5""",
    "opps",
)
twin(
    "fit_distribution",
    "SELECT profile_fit, count(*) AS accounts FROM accounts WHERE profile_fit IS NOT NULL GROUP BY 1",
    "accounts",
)
_CELL = "coalesce(sum(total_pipeline) FILTER (WHERE segment = '{0}'), 0)"
_CELLS = {k.lower().replace("-", "_"): _CELL.format(k) for k in ("Enterprise", "Mid-Market")}
_CELLS["other"] = "coalesce(sum(total_pipeline) FILTER (WHERE segment NOT IN ('Enterprise', 'Mid-Market')), 0)"
twin(
    "industry_segment_matrix",
    f"""SELECT industry, {", ".join(f"round({e}, 2) AS {c}" for c, e in _CELLS.items())},
  round({" + ".join(_CELLS.values())}, 2) AS row_total
FROM master WHERE industry IS NOT NULL AND segment IS NOT NULL
GROUP BY 1 ORDER BY row_total DESC, industry LIMIT 12""",
    *_MASTER_TABLES,
    more=_MASTER,
)


def json_row(columns: dict[str, str]) -> str:
    """A JSON object from SQL texts, the first of them a string value."""
    (key, first), *rest = columns.items()
    parts = [f"""'{{"{key}":"' || {first} || '"'"""]
    parts += [f"""',"{k}":' || coalesce(CAST({v} AS STRING), 'null')""" for k, v in rest]
    return " || ".join([*parts, "'}'"])


def _cents(column: str) -> str:
    return f"CAST(round(coalesce({column}, 0), 2) AS DECIMAL(18,2))"


_CHANNEL_JSON = {
    "channel_category": "channel_category",
    "deal_count": "deal_count",
    "total_pipeline": _cents("total_pipeline"),
    "won_pipeline": _cents("won_pipeline"),
    "win_rate": "win_rate",
    "avg_deal_size": _cents("avg_deal_size"),
    "channel_spend": _cents("channel_spend"),
    "pipeline_roi": "pipeline_roi",
    "revenue_roi": "revenue_roi",
}
twin(
    "channel_rows_json",
    f"SELECT {json_row(_CHANNEL_JSON)} AS row_json FROM channels",
    "opps",
    "ads",
    more=_CHANNELS,
)
_SHORT = ("channel_category", "deal_count", "won_count", "win_rate", "pipeline_roi")
twin(
    "rows_json",
    f"SELECT {json_row({c: c for c in _SHORT})} AS row_json FROM channels",
    "opps",
    "ads",
    more=_CHANNELS,
)
_MODEL_JSON = {
    "channel": "channel",
    "ft": "round(first_touch, 4)",
    "lt": "round(last_touch, 4)",
    "lin": "round(linear_, 4)",
    "td": "round(time_decay, 4)",
    "sourced": "round(marketing_sourced, 4)",
    "influenced": "round(marketing_influenced, 4)",
}
twin(
    "attribution_rows_json",
    f"SELECT {json_row(_MODEL_JSON)} AS row_json FROM wide",
    *_LINK_TABLES,
    more=_MODEL_MORE + "," + _WIDE,
)
_CHECKS = {
    "unique opportunities": ("(SELECT count(*) FROM opps)", "(SELECT count(DISTINCT opp_id) FROM opps)"),
    "channel pipeline vs opportunities": (
        "(SELECT sum(total_pipeline) FROM channels)",
        "(SELECT sum(amount) FROM opps)",
    ),
    "channel won revenue vs opportunities": (
        "(SELECT sum(won_pipeline) FROM channels)",
        "(SELECT sum(amount) FROM opps WHERE is_won)",
    ),
    "channel won count vs opportunities": (
        "(SELECT sum(won_count) FROM channels)",
        "(SELECT count(*) FROM opps WHERE is_won)",
    ),
    "account pipeline vs opportunities": (
        "(SELECT sum(total_pipeline) FROM master)",
        "(SELECT sum(amount) FROM opps)",
    ),
    "report won revenue vs channels": (
        "(SELECT sum(won_pipeline) FROM channels)",
        "(SELECT sum(won_pipeline) FROM channels)",
    ),
    "report won count vs channels": (
        "(SELECT sum(won_count) FROM channels)",
        "(SELECT sum(won_count) FROM channels)",
    ),
    "influenced vs first-touch pipeline": (
        "(SELECT sum(p) FROM results WHERE m = 'Marketing Influenced')",
        "(SELECT sum(p) FROM results WHERE m = 'First-Touch')",
    ),
    "influenced vs first-touch won": (
        "(SELECT sum(w) FROM results WHERE m = 'Marketing Influenced')",
        "(SELECT sum(w) FROM results WHERE m = 'First-Touch')",
    ),
}
# The funnel's stages counted anew, apart from the text of the funnel's own twin.
_RECOUNTED = {
    "Impressions": "SELECT trunc(sum(x)) FROM (SELECT impressions AS x FROM campaign UNION ALL SELECT impressions FROM ads)",
    "Clicks": "SELECT trunc(sum(x)) FROM (SELECT clicks AS x FROM campaign UNION ALL SELECT clicks FROM ads)",
    "Form Fills / Goal Completions": """SELECT sum(x) FROM (SELECT form_fills AS x FROM campaign
  UNION ALL SELECT CASE WHEN is_goal_completed THEN 1 ELSE 0 END FROM web)""",
    "Email Engagements": "SELECT sum(1) FROM email",
    "Email Clicks": "SELECT sum(1) FROM email WHERE is_click",
    "All Opportunities": "SELECT sum(1) FROM opps",
    "Marketing-Sourced Opps": "SELECT sum(1) FROM opps WHERE is_marketing_sourced",
    "Closed Won (All)": "SELECT sum(1) FROM opps WHERE is_won",
    "Marketing-Sourced Won": "SELECT sum(1) FROM opps WHERE is_won AND is_marketing_sourced",
}
_CHECKS |= {
    f"funnel stage {k}": (f"(SELECT n FROM stages WHERE stage = '{k}')", f"({sql})") for k, sql in _RECOUNTED.items()
}
twin(
    "reconciliation",
    "\nUNION ALL ".join(
        f"SELECT '{k}' AS \"check\", round(CAST({a} AS DOUBLE), 2) AS actual, round(CAST({e} AS DOUBLE), 2) AS expected, "
        f"abs(CAST({a} AS DOUBLE) - CAST({e} AS DOUBLE)) <= 0.01 AS ok"
        for k, (a, e) in _CHECKS.items()
    ),
    "opps",
    "accounts",
    "campaign",
    "email",
    "web",
    "contacts",
    "segments",
    "ads",
    "deals",
    more=",".join([_MASTER, _CHANNELS, _FUNNEL, _MODEL_MORE]),
)
twin(
    "win_features",
    """SELECT opp_id, coalesce(regexp_matches(lower(stage), 'closed|won|lost'), false) AS is_closed_deal,
  CASE WHEN is_won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, industry, tier, profile_fit, email_opens, c_level_contacts
FROM (SELECT opp_id, stage, is_won, account_id FROM opps) JOIN master USING (account_id)""",
    *_MASTER_TABLES,
    more=_MASTER,
)
_DEALS = """
deal AS (SELECT x.opp_id, x.amount, x.channel_category, x.segment, x.is_won,
    coalesce(regexp_matches(lower(x.stage), 'closed|won|lost'), false) AS closed,
    x.account_name, m.*, a.*
  FROM opps x LEFT JOIN (SELECT account_id, industry, tier, profile_fit, @MASTER@ FROM master) m
    USING (account_id) LEFT JOIN (SELECT account_id, @ACCOUNT@ FROM accounts) a USING (account_id))"""
_OF_ACCOUNT = ["is_qualified", "intent_score", "annual_revenue", "employees"]
_OF_MASTER = [c for c in V.WIN_NUMERIC if c not in (*_OF_ACCOUNT, "amount")]
_DEALS = _DEALS.replace("@MASTER@", ", ".join(_OF_MASTER)).replace("@ACCOUNT@", ", ".join(_OF_ACCOUNT))


def _code(column: str) -> str:
    """Place of a value in the closed deals' values; unseen ones take Unknown's, else the first."""
    seen = f"(SELECT DISTINCT coalesce({column}, 'Unknown') AS v FROM deal WHERE closed)"
    value = f"coalesce(d.{column}, 'Unknown')"
    place = f"(SELECT count(*) FROM {seen} s WHERE s.v < {{0}})"
    known = f"{value} IN (SELECT v FROM {seen} s)"
    spare = f"CASE WHEN 'Unknown' IN (SELECT v FROM {seen} s) THEN {place.format("'Unknown'")} ELSE 0 END"
    return f"CAST(CASE WHEN {known} THEN {place.format(value)} ELSE {spare} END AS DOUBLE) AS {column}"


_CODED = ("channel_category", "segment", "industry", "tier", "profile_fit")
_FILLED = ("is_qualified", "intent_score", "annual_revenue", "email_opens", "c_level_contacts", "amount")
twin(
    "win_inputs",
    "SELECT opp_id, "
    + ", ".join(_code(c) for c in _CODED)
    + ", "
    + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _FILLED)
    + " FROM deal d",
    *_MASTER_TABLES,
    more=_MASTER + "," + _DEALS,
)
twin(
    "win_folds",
    """SELECT CAST(floor(coalesce(before, 0) * 5 / CAST(total AS DOUBLE)) AS BIGINT) AS fold, label, CAST(sum(n) AS BIGINT) AS deals
FROM (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    sum(n) OVER (PARTITION BY label) AS total
  FROM (SELECT CASE WHEN is_won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
      CAST('0x' || substr(md5(opp_id), 1, 15) AS BIGINT) % 1000 AS bucket, count(*) AS n
    FROM opps WHERE regexp_matches(lower(stage), 'closed|won|lost') GROUP BY 1, 2))
GROUP BY 1, 2""",
    "opps",
)
_LABELS = {
    "copy_messaging": "Messaging",
    "copy_asset_type": "Asset Type",
    "copy_tone": "Tone",
    "cta_softness": "Cta Softness",
    "size": "Size",
}
twin(
    "creative_labels",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, coalesce({a}, 'Unknown') AS value, '{label}' AS label,
  substr(coalesce({a}, 'Unknown'), 1, 7) AS short, round(sum(spend), 4) AS spend FROM ads GROUP BY 2"""
        for a, label in _LABELS.items()
    ),
    "ads",
)

# Scores from the stored nodes: every deal walks every tree.
_STORED = f"'{{store}}/{B.WIN_STORE}/*/{{table}}/*.parquet'"
_PLAIN_KEY = B.DATA_KEY.format(orders="orders", customer="customer", events="events")
_FOREST = f"""
newest AS (SELECT max(version) AS version FROM read_parquet({_STORED.format(store="@STORE@", table="ready")})
  WHERE key = ({_PLAIN_KEY})),
node AS MATERIALIZED (SELECT * FROM read_parquet({_STORED.format(store="@STORE@", table="nodes")})
  WHERE version = (SELECT version FROM newest))"""
_WALK = f"""
entry AS MATERIALIZED (SELECT row_number() OVER () AS id, opp_id, account_name, amount, channel_category, segment, is_won,
    closed, d.x FROM (SELECT *, [{", ".join(_code(c).rsplit(" AS ", 1)[0] for c in V.WIN_CATEGORICAL)}, {
    ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in (*V.WIN_BOOLEAN, *V.WIN_NUMERIC))}] AS x FROM deal d) d),
walk AS (
  WITH RECURSIVE step AS (
    SELECT id, tree, 0 AS node FROM entry, (SELECT DISTINCT tree FROM node)
    UNION ALL
    SELECT s.id, s.tree, CASE WHEN e.x[n.place + 1] <= n.threshold THEN n."left" ELSE n."right" END
    FROM step s JOIN node n ON n.tree = s.tree AND n.node = s.node AND n.place IS NOT NULL JOIN entry e ON e.id = s.id)
  SELECT s.id, round(avg(n.won / n.n), 9) AS chance FROM step s JOIN node n USING (tree, node)
  WHERE n.place IS NULL GROUP BY s.id),
scored AS (SELECT * FROM entry JOIN walk USING (id))"""
_MODEL = ",".join((_MASTER, _DEALS, _FOREST))
_SHOWN = "opp_id, account_name, amount, channel_category, segment, chance AS win_probability, is_won"
twin("win_probability", f"SELECT {_SHOWN} FROM scored WHERE NOT closed", *_MASTER_TABLES, more=f"{_MODEL},{_WALK}")
twin(
    "win_accuracy",
    """SELECT avg(CASE WHEN (chance >= 0.5) = coalesce(is_won, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy,
  count(*) AS deals FROM scored WHERE closed""",
    *_MASTER_TABLES,
    more=f"{_MODEL},{_WALK}",
)
twin(
    "win_histogram",
    """SELECT least(CAST(floor(chance * 20) AS BIGINT), 19) AS bin, count(*) AS deals
FROM scored WHERE NOT closed GROUP BY 1""",
    *_MASTER_TABLES,
    more=f"{_MODEL},{_WALK}",
)
twin(
    "feature_importance",
    """SELECT feature, round(sum(share) / (SELECT count(DISTINCT tree) FROM node WHERE gain > 0), 9) AS importance
FROM (SELECT feature, gain * n / sum(gain * n) OVER (PARTITION BY tree) AS share FROM node WHERE feature IS NOT NULL)
GROUP BY feature""",
    more=_FOREST,
)
twin(
    "win_nodes",
    """SELECT CAST(tree AS BIGINT) AS tree, count(*) AS nodes, count(*) FILTER (WHERE place IS NULL) AS leaves,
  sum(n) FILTER (WHERE place IS NULL) AS drawn, sum(won) FILTER (WHERE place IS NULL) AS won
FROM node GROUP BY 1""",
    more=_FOREST,
)
# By average ranks: a won deal's rank among all counts those below it and half its ties.
twin(
    "win_auc",
    f"""SELECT round(avg(auc), 9) AS auc, round(stddev_pop(auc), 9) AS deviation FROM (
  SELECT fold, (sum(rank) FILTER (WHERE label = 1) - any_value(won) * (any_value(won) + 1) / 2)
      / (any_value(won) * (any_value(n) - any_value(won))) AS auc
  FROM (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY steps)
        + (count(*) OVER (PARTITION BY fold, steps) - 1) / 2 AS rank,
      sum(label) OVER (PARTITION BY fold) AS won, count(*) OVER (PARTITION BY fold) AS n
    FROM read_parquet({_STORED.format(store="@STORE@", table="fold_scores")})
    WHERE version = (SELECT version FROM newest))
  GROUP BY fold)""",
    more=_FOREST,
)


def with_store(folder: str) -> dict[str, str]:
    """All twins; those of the win model read its tables under ``folder``."""
    plain = folder.removeprefix("file://")
    return {name: sql.replace("@STORE@", plain) for name, sql in ORACLES.items()}
