"""The given tables seen as the engine's logical tables.

Each binding is one SELECT in the SQL that Spark and DuckDB share, so the query
and its SQL twin start from the same rows.  ``{orders}`` and the like stand for
the given tables.  The given data has no nulls and no dirty text, so bindings
put some in by fixed rules on the keys.  Ad spend is in quarter dollars, which
doubles add exactly in any order.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

GIVEN = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_K = "regexp_extract(props, '([0-9]+)', 1)"
_SENIORITY = """CASE {0} % 5 WHEN 0 THEN 'C-Level' WHEN 1 THEN 'VP' WHEN 2 THEN 'Director'
    WHEN 3 THEN 'Manager' ELSE 'Unknown' END"""
_UTM = """CASE event_id % 6 WHEN 0 THEN '6si' WHEN 1 THEN 'HS_Email' WHEN 2 THEN 'linkedin_ads'
    WHEN 3 THEN 'google' WHEN 4 THEN '6sense-ads' END"""
_US_DATE = (
    "CAST(month({0}) AS STRING) || '/' || CAST(day({0}) AS STRING) || '/' || CAST(year({0}) AS STRING)"
)

# Lead source (order priority) -> channel, and ad platform -> channel.
CHANNEL_OF_PRIORITY = {
    "1-URGENT": "6sense_display",
    "2-HIGH": "email_mqa",
    "3-MEDIUM": "web_inbound",
    "5-LOW": "referral",
}
PLATFORMS = {"A": "6sense_display", "N": "email_mqa", "R": "web_inbound"}
FITS = ["Strong", "Moderate"]
# Domains that mail reached and a paid channel too, without a direct visit.
AUDIENCE = {"all_of": ["email_mqa"], "any_of": ["6sense_display", "linkedin"], "none_of": ["web_inbound"]}
WINDOW_DAYS, HALF_LIFE = 7, 3

TYPED = {
    "opps": """
SELECT CAST(o_orderkey AS STRING) AS opp_id,
  CASE WHEN o_orderkey % 41 = 7 THEN 'X' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END
    AS account_id,
  CASE WHEN o_orderkey % 3 > 0 THEN 'Account ' || CAST(o_custkey AS STRING) END AS account_name,
  CASE WHEN o_orderkey % 5 > 0 THEN 'acct' || CAST(o_custkey AS STRING) || '.com' END AS domain,
  CASE WHEN o_orderkey % 97 > 0 THEN o_totalprice END AS amount,
  o_orderdate AS create_date,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS is_won,
  o_orderpriority AS lead_source,
  CASE o_orderpriority WHEN '1-URGENT' THEN '6sense_display' WHEN '2-HIGH' THEN 'email_mqa'
    WHEN '3-MEDIUM' THEN 'web_inbound' WHEN '5-LOW' THEN 'referral' ELSE 'other' END AS channel_category,
  o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS is_marketing_sourced,
  CASE o_orderkey % 4 WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'Mid-Market' WHEN 2 THEN 'Commercial' END AS segment,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Closed Won'
    WHEN o_orderstatus = 'P' THEN 'Closed Lost' WHEN o_orderkey % 3 = 0 THEN 'Qualify'
    WHEN o_orderkey % 3 = 1 THEN 'Negotiate' ELSE 'Commit' END AS stage,
  CASE WHEN o_orderstatus = 'P' THEN 'Reason ' || CAST(o_orderkey % 7 AS STRING) END AS lost_reason
FROM {orders}""",
    "closings": """
SELECT CAST(l_orderkey AS STRING) AS opp_id, max(l_shipdate) AS close_date
FROM {lineitem} GROUP BY l_orderkey""",
    "accounts": """
SELECT CAST(c_custkey AS STRING) AS account_id,
  c_name AS account_name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL
    WHEN c_custkey % 29 = 3 THEN 'acct' || CAST(c_custkey - 1 AS STRING) || '.com'
    ELSE 'acct' || CAST(c_custkey AS STRING) || '.com' END AS domain,
  n_name AS country,
  c_mktsegment AS industry,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS annual_revenue,
  CAST(c_custkey % 5000 AS DOUBLE) AS employees,
  CAST(c_custkey % 100 AS DOUBLE) AS intent_score,
  CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 4 = 0 END AS is_qualified,
  r_name AS tier,
  CASE WHEN c_acctbal >= 6000 THEN 'Enterprise' WHEN c_acctbal >= 2000 THEN 'Mid-Market'
    WHEN c_acctbal >= 0 THEN 'Commercial' END AS segment,
  CASE c_custkey % 4 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Weak' END AS profile_fit
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "deals": f"""
SELECT CAST(event_id AS STRING) AS opp_id,
  CAST(user_id AS STRING) AS account_id,
  CASE WHEN event_id % 4 > 0 THEN 'https://www.ACCT' || CAST(user_id AS STRING) || '.com/' END AS domain,
  CASE WHEN event_id % 50 > 0 THEN value END AS amount,
  ts AS create_date,
  CASE WHEN event_id % 7 > 0 THEN event_id % 3 = 0 END AS is_won,
  CASE event_id % 5 WHEN 0 THEN '6sense_display' WHEN 1 THEN 'email_mqa' WHEN 2 THEN 'web_inbound'
    WHEN 3 THEN 'referral' ELSE 'other' END AS channel_category,
  event_id % 5 < 3 AS is_marketing_sourced
FROM {{events}} WHERE event_type = 'purchase'""",
    "campaign": f"""
SELECT 'acct' || CAST(user_id AS STRING) || '.com' AS domain,
  'c' || {_K} AS campaign_id,
  value AS spend,
  CAST(event_id % 3 AS DOUBLE) AS clicks,
  CAST(floor(value * 100) AS DOUBLE) AS impressions,
  CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS form_fills,
  date_trunc('day', ts) AS activity_date,
  CASE WHEN event_id % 5 > 0 THEN ts END AS latest_impression,
  substr(CAST(ts AS STRING), 1, 7) AS month_year
FROM {{events}} WHERE event_type = 'click'""",
    "email": f"""
SELECT ts AS event_time,
  'acct' || CAST(user_id AS STRING) || '.com' AS domain,
  CASE WHEN user_id % 8 > 0 THEN 'Industry ' || CAST(user_id % 23 AS STRING) END AS industry,
  {_SENIORITY.format("user_id")} AS seniority,
  'c' || {_K} AS campaign_id,
  CASE WHEN event_id % 10 > 0 THEN 'Subject ' || CAST(event_id % 9 AS STRING) END AS subject,
  'Q' || CAST(user_id % 4 + 1 AS STRING) AS quarter_segment,
  event_type = 'view' AND event_id % 4 > 0 AS is_open,
  event_type = 'view' AND event_id % 4 = 0 AS is_click,
  event_type = 'signup' AS is_register
FROM {{events}} WHERE event_type IN ('view', 'signup')""",
    "web": f"""
SELECT ts AS event_time,
  CASE WHEN user_id % 10 > 0 THEN 'acct' || CAST(user_id AS STRING) || '.com' END AS domain,
  CAST({_K} AS DOUBLE) AS session_views,
  {_UTM} AS utm_source,
  'w' || {_K} AS utm_campaign,
  CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_goal_completed,
  event_id % 6 = 0 AS is_display_traffic,
  event_id % 6 = 1 AS is_email_traffic,
  event_id % 6 = 2 AS is_social_traffic,
  event_id % 6 = 3 AS is_organic,
  user_id % 10 > 0 AS has_domain
FROM {{events}} WHERE event_type IN ('error', 'purchase')""",
    "ads": """
SELECT l_shipdate AS activity_date,
  CAST(floor(l_extendedprice * l_discount * 4) AS DOUBLE) / 4 AS spend,
  CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS clicks,
  CAST(floor(l_extendedprice) AS DOUBLE) AS impressions,
  CAST(floor(l_quantity / 2) AS DOUBLE) AS pageviews,
  l_returnflag AS platform,
  p_name AS ad_name,
  CAST(p_size % 10 AS STRING) AS size,
  CAST(NULL AS STRING) AS stage,
  p_brand AS copy_messaging,
  CASE WHEN p_partkey % 9 > 0 THEN p_type END AS copy_asset_type,
  l_linestatus AS copy_tone,
  CASE WHEN l_tax > 0.04 THEN 'hard' ELSE 'soft' END AS cta_softness,
  CAST(NULL AS STRING) AS design_color,
  CAST(NULL AS STRING) AS campaign_id
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "contacts": f"""
SELECT CAST(o_custkey AS STRING) AS account_id,
  {_SENIORITY.format("o_orderkey")} AS seniority,
  CASE WHEN o_orderkey % 9 > 0 THEN CASE o_orderstatus WHEN 'F' THEN 'Customer' WHEN 'P' THEN 'Lead'
    ELSE 'MQL' END END AS lifecycle_stage
FROM {{orders}}""",
    "segments": """
SELECT 'acct' || CAST(user_id AS STRING) || '.com' AS domain,
  ts AS activity_date,
  CASE WHEN user_id % 6 = 2 THEN NULL WHEN event_type = 'click' THEN 'High Intent'
    ELSE 'Awareness ' || CAST(event_id % 5 AS STRING) END AS segment,
  CASE WHEN user_id % 6 = 2 THEN NULL WHEN event_type = 'click' THEN 'Intent' ELSE 'Awareness' END
    AS segment_category,
  CASE WHEN event_id % 4 > 0 THEN 'E' || CAST(event_id % 3 AS STRING) END AS employee_range,
  'R' || CAST(event_id % 6 AS STRING) AS revenue_range
FROM {events} WHERE event_type IN ('click', 'view')""",
    "reached_email": """
SELECT CASE WHEN user_id % 3 = 0 THEN 'mail' ELSE 'acct' END || CAST(user_id AS STRING) || '.com' AS domain
FROM {events} WHERE event_type IN ('view', 'signup')""",
    "reached_display": """
SELECT CASE WHEN user_id % 4 = 0 THEN 'Shown' ELSE ' Acct' END || CAST(user_id AS STRING) || '.com ' AS domain
FROM {events} WHERE event_type = 'click'""",
}

# Raw exports: every column text, raw names, null tokens and mixed formats.
RAW = {
    "raw_opportunities": f"""
SELECT CAST(l_orderkey AS STRING) AS _opportunity_id,
  CASE WHEN l_linenumber = 7 THEN 'null' ELSE CAST(l_linenumber AS STRING) END AS _order,
  'A' || CAST(l_suppkey AS STRING) AS _account_id,
  CASE WHEN l_quantity = 50 THEN '-' WHEN l_quantity = 49 THEN 'n/a'
    ELSE CAST(l_extendedprice AS STRING) END AS _amount,
  CASE WHEN l_quantity < 10 THEN {_US_DATE.format("l_shipdate")} WHEN l_quantity = 10 THEN 'bad'
    ELSE CAST(l_shipdate AS STRING) END AS _createdate,
  CASE l_returnflag WHEN 'A' THEN 'True' WHEN 'R' THEN 'no' ELSE 'NULL' END AS iswon,
  CASE l_suppkey % 5 WHEN 0 THEN 'Marketing: MQA' WHEN 1 THEN 'Web Inbound' WHEN 2 THEN 'Cold Call'
    WHEN 3 THEN 'None' ELSE 'Somewhere else' END AS _leadsource,
  ' Segment ' || CAST(l_suppkey % 3 AS STRING) || ' ' AS segment__c,
  CASE WHEN l_linestatus = 'F' THEN 'Closed' ELSE 'Open' END AS _current_stage,
  CAST(l_partkey * 100000000 + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING) AS row_key
FROM {{lineitem}}""",
    "raw_accounts": f"""
SELECT CAST(c_custkey AS STRING) AS accountid,
  CASE c_custkey % 5 WHEN 0 THEN 'https://www.Acct' || CAST(c_custkey AS STRING) || '.com/'
    WHEN 1 THEN 'HTTP://acct' || CAST(c_custkey AS STRING) || '.com//'
    WHEN 2 THEN ' acct' || CAST(c_custkey AS STRING) || '.com/x/ ' WHEN 3 THEN 'nan'
    ELSE 'None' END AS domain__c,
  CASE c_nationkey % 4 WHEN 0 THEN 'usa' WHEN 1 THEN ' UK ' WHEN 2 THEN 'cote d''ivoire'
    ELSE 'guinea-bissau' END AS billingcountry,
  CASE c_custkey % 6 WHEN 0 THEN 'COMPUTER_SOFTWARE' WHEN 1 THEN ' It Services ' WHEN 2 THEN 'E-Learning'
    WHEN 3 THEN '-' ELSE c_mktsegment END AS industry,
  CASE WHEN c_custkey % 10 = 0 THEN 'unknown' ELSE CAST(c_acctbal * 100000 AS STRING) END AS annualrevenue,
  CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN 'TRUE' ELSE '1' END
    AS account6qa6sense__c,
  CASE c_custkey % 3 WHEN 0 THEN 'TBD' WHEN 1 THEN 'Tier 1' ELSE '' END AS tier,
  CASE WHEN c_custkey % 7 = 0 THEN 'Given' ELSE 'NULL' END AS segment__c
FROM {{customer}}""",
    "raw_campaign": f"""
SELECT 'www.Acct' || CAST(user_id AS STRING) || '.com' AS _6sensedomain,
  'c' || {_K} AS _campaignid,
  CASE WHEN event_id % 9 = 0 THEN 'null' ELSE CAST(value AS STRING) END AS _spend,
  CAST(event_id % 3 AS STRING) AS _clicks,
  CAST(event_id % 4 * 100 AS STRING) AS _impressions,
  CASE event_id % 5 WHEN 0 THEN '2' WHEN 1 THEN 'null' ELSE '0' END AS _influencedformfills,
  CASE WHEN event_id % 8 = 0 THEN '-' ELSE CAST(date_trunc('day', ts) AS STRING) END AS _date,
  CAST(ts AS STRING) AS _latestimpression,
  '1' AS _sdc_sequence
FROM {{events}} WHERE event_type = 'click'""",
    "raw_ads": f"""
SELECT {_US_DATE.format("l_shipdate")} AS day,
  CAST(l_extendedprice AS STRING) AS _spend,
  CASE WHEN l_linenumber = 1 THEN '0' ELSE CAST(l_quantity AS STRING) END AS _clicks,
  CASE WHEN l_linenumber = 2 THEN '0' ELSE CAST(l_partkey AS STRING) END AS _impressions,
  CASE WHEN l_linenumber = 3 THEN 'None' ELSE CAST(l_suppkey AS STRING) END AS pageviews,
  ' ' || l_returnflag || ' ' AS _platform,
  'x' AS _screenshot
FROM {{lineitem}}""",
    "raw_email": f"""
SELECT CAST(ts AS STRING) AS _timestamp,
  CASE WHEN event_id % 6 = 0 THEN {_US_DATE.format("ts")}
    ELSE CAST(ts - INTERVAL 36 HOURS AS STRING) END AS _campaignSentDate,
  'Acct' || CAST(user_id AS STRING) || '.com/' AS _domain,
  CASE WHEN user_id % 2 = 0 THEN 'MEDIA_PRODUCTION' ELSE ' Other line ' END AS _industry,
  CASE user_id % 4 WHEN 0 THEN ' VP ' WHEN 1 THEN 'null' ELSE 'Director' END AS _seniority,
  CASE event_type WHEN 'view' THEN 'Opened' WHEN 'click' THEN 'CLICKED' WHEN 'signup' THEN 'register'
    WHEN 'error' THEN 'bounced' ELSE '-' END AS _engagement,
  'c' || {_K} AS _campaignID,
  ' Subject' || chr(10) || 'of ' || CAST(event_id % 9 AS STRING) || chr(13) AS _campaign_subject
FROM {{events}}""",
    "raw_web": f"""
SELECT CAST(ts AS STRING) AS _timestamp,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 'acct' || CAST(user_id AS STRING) || '.com' END AS _domain,
  {_K} AS _totalsessionviews,
  {_UTM} AS _utmsource,
  CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN 'yes' ELSE 'NULL' END
    AS _goalcompletion
FROM {{events}}""",
    "raw_contacts": """
SELECT CAST(o_custkey AS STRING) AS _sfdcaccountid,
  CASE o_orderkey % 6 WHEN 0 THEN 'Gmail.com' WHEN 1 THEN 'www.yahoo.com/' WHEN 2 THEN 'null'
    ELSE 'acct' || CAST(o_custkey AS STRING) || '.com' END AS _domain,
  CASE o_orderkey % 5 WHEN 0 THEN 'None' ELSE ' Director' END AS _seniority,
  CASE o_orderstatus WHEN 'F' THEN ' Customer' WHEN 'P' THEN 'salesqualifiedlead' ELSE 'New stage' END
    AS _lifecycleStage,
  CASE WHEN o_orderkey % 4 = 0 THEN 'many' ELSE CAST(o_custkey AS STRING) END AS _employee,
  'a@b.c' AS _emails
FROM {orders}""",
    "raw_segments": """
SELECT 'https://acct' || CAST(user_id AS STRING) || '.com' AS _6sensedomain,
  CAST(ts AS STRING) AS _date,
  CASE event_type WHEN 'view' THEN 'Why MAAS intent list' WHEN 'click' THEN 'High INTENT'
    WHEN 'signup' THEN 'Named Account list' WHEN 'error' THEN 'Misc' ELSE 'NULL' END AS _segment,
  'E' || CAST(event_id % 3 AS STRING) AS _6senseemployeerange
FROM {events}""",
}

ALL = {**TYPED, **RAW}

# Schemas by path and time of writing: finding one costs a job, and a query reads a table several times.
_SCHEMAS: dict[tuple[str, int], T.StructType] = {}


def written_at(spark: SparkSession, path: str) -> int:
    """When a file or folder was last written, in milliseconds, on any file system Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


# Stored models lie under the shared folder, each marked with the tables it was fitted to.
WIN_STORE = "win-model"
DATA_KEY = """
SELECT concat_ws('-', (SELECT count(*) FROM {orders}), (SELECT coalesce(sum(o_orderkey), 0) FROM {orders}),
  (SELECT count(*) FROM {customer}), (SELECT count(*) FROM {events})) AS data_key"""


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its zone-less times are read as UTC instants.

    The type is set on the scan rather than by a cast, so filters on time still
    reach the files.
    """
    path = f"{folder}/{name}.parquet"
    key = path, written_at(spark, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = T.StructType(
            [
                T.StructField(f.name, T.TimestampType(), f.nullable)
                if isinstance(f.dataType, T.TimestampNTZType)
                else f
                for f in spark.read.parquet(path).schema.fields
            ]
        )
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def bound(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A logical table over the given tables in ``folder``."""
    text = ALL[name]
    tables = {t: given(spark, folder, t) for t in GIVEN if "{" + t + "}" in text}
    return spark.sql(text, **tables)


@lru_cache(maxsize=None)
def cte(*names: str) -> str:
    """The same logical tables as a WITH clause for the SQL twins."""
    plain = {t: t for t in GIVEN}
    parts = [f"{name} AS ({ALL[name].format(**plain).strip()})" for name in names]
    return "WITH " + ",\n".join(parts)
