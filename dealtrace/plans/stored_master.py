"""The account table from bucketed stage tables, brought up to date month by month.

Three tables: what each month adds to a domain's facts, by month and bucketed by
domain; accounts with their domain's facts, and deal and contact totals, both
bucketed by account.  Months are merged, and the two account tables joined,
without a shuffle.  New events of a month rewrite that month's partition and the
accounts' table; no other month's events are read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.aggregate import total
from ..operators.lookup import lookup_join
from ..sources.buckets import BucketedTable
from .account360 import account_facts, with_account_facts

# The partition of rows without a date.
UNDATED = "undated"

_FIRST = {"segment_category": "segment_category", "emp_range": "employee_range", "rev_range": "revenue_range"}
_SUMS = (
    "spend",
    "clicks",
    "impressions",
    "form_fills",
    "opens",
    "mail_clicks",
    "registers",
    "sessions",
    "session_views",
    "goals",
)


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of facts added up by ``by``: sums, and of each first value the one seen first."""
    return rows.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in _SUMS), *(F.min(f"first_{c}").alias(f"first_{c}") for c in _FIRST)
    )


def monthly_facts(segments: DataFrame, campaign: DataFrame, email: DataFrame, web: DataFrame) -> DataFrame:
    """What each month adds to a domain: one row per month, domain, source and item.

    The item is the segment or the mailed campaign; the other sources have none.
    So a domain has as many rows in a month as segments and campaigns, whatever
    its events.  All columns can be added up again.
    """

    def rows(df: DataFrame, source: str, time: str, item, *facts) -> DataFrame:
        month = F.coalesce(S.month(time), F.lit(UNDATED)).alias("month")
        named = df.where(F.col("domain").isNotNull())
        return named.select(month, "domain", F.lit(source).alias("source"), item.cast("string").alias("item"), *facts)

    def count_of(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(False)).cast("bigint")

    nothing = F.lit(None)
    seen = F.struct(
        F.col("activity_date").isNull().alias("undated"),
        "activity_date",
        "segment",
        "employee_range",
        "revenue_range",
    )
    first = [
        F.when(F.col(c).isNotNull(), F.struct(seen.alias("seen"), F.col(c).alias("value"))).alias(f"first_{name}")
        for name, c in _FIRST.items()
    ]
    sources = [
        rows(segments, "segments", "activity_date", F.col("segment"), *first),
        rows(campaign, "campaign", "activity_date", nothing, "spend", "clicks", "impressions", "form_fills"),
        rows(
            email,
            "email",
            "event_time",
            F.col("campaign_id"),
            count_of(F.col("is_open")).alias("opens"),
            count_of(F.col("is_click")).alias("mail_clicks"),
            count_of(F.col("is_register")).alias("registers"),
        ),
        rows(
            web,
            "web",
            "event_time",
            nothing,
            F.lit(1).cast("bigint").alias("sessions"),
            "session_views",
            count_of(S.is_true("is_goal_completed")).alias("goals"),
        ),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return _merged(stacked, "month", "domain", "source", "item")


def facts_of(monthly: DataFrame) -> DataFrame:
    """One row per domain from the months' rows, the columns of ``account360.domain_facts``.

    Both groupings go by domain or finer, so rows bucketed by domain stay where they are.
    """
    items = _merged(monthly, "domain", "source", "item")

    def of(source: str):
        return F.col("source") == source

    def within(source: str, column: str, to: str, name: str):
        return F.when(F.count_if(of(source)) > 0, total(column, to)).alias(name)

    return items.groupBy("domain").agg(
        F.when(
            F.count_if(of("segments")) > 0, F.array_sort(F.collect_set(F.when(of("segments"), F.col("item"))))
        ).alias("segment_list"),
        *(F.min(f"first_{c}")["value"].alias(c) for c in _FIRST),
        within("campaign", "spend", "double", "campaign_spend"),
        within("campaign", "clicks", "double", "campaign_clicks"),
        within("campaign", "impressions", "double", "campaign_impressions"),
        within("campaign", "form_fills", "bigint", "campaign_form_fills"),
        within("email", "opens", "bigint", "email_opens"),
        within("email", "mail_clicks", "bigint", "email_clicks"),
        within("email", "registers", "bigint", "email_registers"),
        F.when(F.count_if(of("email")) > 0, F.count(F.when(of("email"), F.col("item")))).alias(
            "unique_email_campaigns"
        ),
        F.when(F.count_if(of("web")) > 0, F.sum("sessions")).alias("web_sessions"),
        within("web", "session_views", "double", "web_pageviews"),
        within("web", "goals", "bigint", "web_goal_completions"),
    )


@dataclass(frozen=True)
class MasterStore:
    """The three tables under one folder; ``buckets`` is chosen once, for the size they will grow to."""

    folder: str
    buckets: int = 256

    def _table(self, df: DataFrame, name: str, key: str, partition: str | None = None) -> BucketedTable:
        return BucketedTable(f"{self.folder}/{name}", key, df.schema, self.buckets, partition)

    def write_months(
        self, segments: DataFrame, campaign: DataFrame, email: DataFrame, web: DataFrame
    ) -> BucketedTable:
        """Replace the months these rows lie in; rows must hold such a month whole."""
        monthly = monthly_facts(segments, campaign, email, web)
        table = self._table(monthly, "domain_months", "domain", "month")
        table.overwrite(monthly)
        return table

    def write_accounts(self, accounts: DataFrame, opps: DataFrame, contacts: DataFrame, months: BucketedTable) -> None:
        """Write accounts with the facts of all stored months, and deal and contact totals."""
        spark = accounts.sparkSession
        named = accounts
        if "account_name" not in accounts.columns:
            named = accounts.withColumn("account_name", F.lit(None).cast("string"))
        # A domain may own a third of the accounts, so they meet its facts by a join that can be split.
        base = lookup_join(named, facts_of(months.read(spark)), "domain", spread="account_id")
        by_account = account_facts(opps, contacts)
        for df, name in ((base, "accounts"), (by_account, "account_facts")):
            self._table(df, name, "account_id").overwrite(df)
            df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/schema_{name}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The account table, by one join of two tables dealt alike; in any session that sees the folder."""
        frames = []
        for name in ("accounts", "account_facts"):
            like = spark.read.parquet(f"{self.folder}/schema_{name}")
            frames.append(self._table(like, name, "account_id").read(spark))
        return with_account_facts(*frames)
