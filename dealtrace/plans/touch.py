"""Touch log and the link from touches to deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators import intervals, sweep
from ..operators.lookup import lookup_join


def _touch(df: DataFrame, date, channel, kind, campaign) -> DataFrame:
    rows = df.select(
        "domain",
        date.alias("touch_date"),
        channel.alias("channel"),
        kind.alias("touch_type"),
        campaign.alias("campaign_id"),
    )
    return rows.where(F.col("domain").isNotNull() & F.col("touch_date").isNotNull())


def display_touches(campaign: DataFrame) -> DataFrame:
    """A campaign row touches at its latest impression, else on its date."""
    return _touch(
        campaign,
        F.coalesce("latest_impression", "activity_date"),
        F.lit(V.DISPLAY_CHANNEL),
        F.lit(V.DISPLAY_TOUCH),
        F.col("campaign_id"),
    )


def email_touches(email: DataFrame) -> DataFrame:
    return _touch(
        email,
        F.col("event_time"),
        F.lit(V.EMAIL_CHANNEL),
        S.email_touch_type("is_click", "is_register"),
        F.col("campaign_id"),
    )


def web_touches(web: DataFrame) -> DataFrame:
    channel, kind = S.web_touch("utm_source")
    return _touch(web, F.col("event_time"), channel, kind, F.col("utm_campaign"))


def touchpoints(campaign: DataFrame, email: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """Union of three narrow projections; without ``web`` the journey form."""
    log = display_touches(campaign).unionByName(email_touches(email))
    return log if web is None else log.unionByName(web_touches(web))


def touch_summary(touches: DataFrame) -> DataFrame:
    """Rows, domains and time range of the log per channel and type."""
    return touches.groupBy("channel", "touch_type").agg(
        F.count(F.lit(1)).alias("touches"),
        F.countDistinct("domain").alias("domains"),
        F.min("touch_date").alias("first_touch"),
        F.max("touch_date").alias("last_touch"),
    )


def resolve_domains(
    opps: DataFrame, accounts: DataFrame | None = None, domain_source: str = "fallback"
) -> DataFrame:
    """Normalise the deal's domain; fall back to its account's.

    Every deal stays, with a null domain if neither has one.  ``own_only``
    ignores the accounts.  An account id listed twice gives its latest created
    row's domain.
    """
    if domain_source not in ("fallback", "own_only"):
        raise ValueError(f"domain_source must be 'fallback' or 'own_only', not {domain_source!r}")
    own = opps.withColumn("domain", S.domain("domain"))
    if accounts is None or domain_source == "own_only":
        return own
    created = F.col("created_date") if "created_date" in accounts.columns else F.lit(None)
    by_account = (
        accounts.where(F.col("account_id").isNotNull() & F.col("domain").isNotNull())
        .groupBy("account_id")
        .agg(F.max_by("domain", F.struct(created, F.col("domain"))).alias("_account_domain"))
    )
    # Only deals without a domain need the lookup; the others skip the shuffle.
    with_own = own.where(F.col("domain").isNotNull())
    without = own.where(F.col("domain").isNull())
    found = (
        lookup_join(without, by_account, "account_id", "left", spread="opp_id")
        .withColumn("domain", F.col("_account_domain"))
        .select(*own.columns)
    )
    return with_own.unionByName(found)


def attributable(
    opps: DataFrame, accounts: DataFrame | None = None, domain_source: str = "fallback"
) -> DataFrame:
    """Deals that can be linked: with domain, create date and amount."""
    complete = opps.where(F.col("create_date").isNotNull() & F.col("amount").isNotNull())
    return resolve_domains(complete, accounts, domain_source).where(F.col("domain").isNotNull())


def _linkable(opps: DataFrame, accounts: DataFrame | None, domain_source: str) -> DataFrame:
    return attributable(opps, accounts, domain_source).select(
        "opp_id", "domain", "create_date", "amount", "channel_category", "is_marketing_sourced", "is_won"
    )


def linked_intervals(
    opps: DataFrame,
    touches: DataFrame,
    accounts: DataFrame | None = None,
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    domain_source: str = "fallback",
) -> intervals.TouchIntervals:
    """Deals with the interval of their domain's numbered touches, and those touches."""
    return intervals.touch_intervals(_linkable(opps, accounts, domain_source), touches, window_days)


def linked_touches(
    opps: DataFrame,
    touches: DataFrame,
    accounts: DataFrame | None = None,
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    domain_source: str = "fallback",
) -> DataFrame:
    """One row per deal and touch in its window: the intervals, expanded."""
    return intervals.expand(linked_intervals(opps, touches, accounts, window_days, domain_source))


def deal_links(
    opps: DataFrame,
    touches: DataFrame,
    accounts: DataFrame | None = None,
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    half_life_days: float = V.HALF_LIFE_DAYS,
    domain_source: str = "fallback",
) -> DataFrame:
    """Per deal and touch channel: touches, first, last and decayed weight."""
    deals = attributable(opps, accounts, domain_source).select(
        "opp_id",
        "domain",
        "create_date",
        "amount",
        "channel_category",
        S.is_true("is_won").alias("is_won"),
    )
    carry = ["amount", "channel_category", "is_won"]
    return sweep.deal_channel_links(deals, touches, window_days, half_life_days, carry)


def link_summary(
    opps: DataFrame,
    touches: DataFrame,
    accounts: DataFrame | None = None,
    window_days: int = V.ATTRIBUTION_WINDOW_DAYS,
    half_life_days: float = V.HALF_LIFE_DAYS,
    domain_source: str = "fallback",
) -> DataFrame:
    """Per deal, channel, touch type and campaign: touches, first, last and decayed weight.

    What the linked-touch table says, without a row for each pair.
    """
    deals = attributable(opps, accounts, domain_source).select("opp_id", "domain", "create_date")
    by = ["channel", "touch_type", "campaign_id"]
    return intervals.links_by_kind(deals, touches, by, window_days, half_life_days)


__all__ = [
    "attributable",
    "deal_links",
    "display_touches",
    "email_touches",
    "link_summary",
    "linked_intervals",
    "linked_touches",
    "resolve_domains",
    "touch_summary",
    "touchpoints",
    "web_touches",
]
