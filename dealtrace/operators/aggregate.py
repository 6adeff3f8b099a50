"""Group-by building blocks shared by the reports.

Null group keys are dropped and a sum over nothing is zero.  Every aggregate
here is decomposable, so Spark reduces it before the shuffle and a key holding
a large share of the rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def drop_null_keys(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    names = _names(by)
    return df.na.drop(subset=names) if names else df


def total(c: str | Column, to: str = "double") -> Column:
    """Sum that is zero instead of null.

    Whole units are added apart from the rest: exactly, up to 2^53, so that a total of
    billions keeps its cents in whatever order tasks add.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    whole = F.rint(c)
    rest = F.when(c == whole, F.lit(0.0)).otherwise(c - whole)
    return F.coalesce(F.sum(whole) + F.sum(rest), F.lit(0)).cast(to)


def _won_amount() -> Column:
    return F.when(S.is_true("is_won"), F.col("amount"))


def deal_summary(deals: DataFrame, by: str | Sequence[str], digits: int | None = None) -> DataFrame:
    """Deals, won deals, pipeline, won pipeline, average and win rate by key."""
    return (
        drop_null_keys(deals, by)
        .groupBy(*_names(by))
        .agg(
            F.count("opp_id").alias("deals"),
            F.count_if(S.is_true("is_won")).alias("won"),
            total("amount").alias("pipeline"),
            total(_won_amount()).alias("won_pipeline"),
            F.avg("amount").alias("avg_deal"),
        )
        .withColumn("win_rate", S.win_rate("won", "deals", digits))
    )


def pre_aggregate_deals(deals: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Additive deal totals per key, to be joined and summed further.

    Joining these instead of deals keeps an account that owns a third of all
    deals down to one row on the join's side.
    """
    return deals.groupBy(*_names(by)).agg(
        F.count("opp_id").alias("deals"),
        F.count_if(S.is_true("is_won")).alias("won"),
        total("amount").alias("pipeline"),
        total(_won_amount()).alias("won_pipeline"),
        F.count("amount").alias("priced"),
    )


def summarise_totals(totals: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Deal summary from :func:`pre_aggregate_deals` rows."""
    return (
        drop_null_keys(totals, by)
        .groupBy(*_names(by))
        .agg(
            F.sum("deals").alias("deals"),
            F.sum("won").alias("won"),
            F.sum("pipeline").alias("pipeline"),
            F.sum("won_pipeline").alias("won_pipeline"),
            F.sum("priced").alias("priced"),
        )
        .select(
            *_names(by),
            "deals",
            "won",
            "pipeline",
            "won_pipeline",
            S.ratio("pipeline", "priced").alias("avg_deal"),
            S.win_rate("won", "deals", None).alias("win_rate"),
        )
    )


def engagement_rates(email: DataFrame, by: str | Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """Email events, opens, clicks, registrations and their rates by key."""
    by = _names(by)
    rows = drop_null_keys(email, by) if by else email
    counted = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("is_open").alias("opens"),
        F.count_if("is_click").alias("clicks"),
        F.count_if("is_register").alias("registers"),
    )
    return counted.select(
        "*",
        S.ratio("opens", "events", digits).alias("open_rate"),
        S.ratio("clicks", "events", digits).alias("click_rate"),
        S.ratio("registers", "events", digits).alias("register_rate"),
        S.ratio("clicks", "opens", digits).alias("click_to_open"),
    )


def ad_totals(ads: DataFrame, by: str | Sequence[str], *measures: str) -> DataFrame:
    """Sums of ad measures by key."""
    measures = measures or ("spend", "clicks", "impressions")
    return (
        drop_null_keys(ads, by)
        .groupBy(*_names(by))
        .agg(*(total(m).alias(m) for m in measures))
    )


def count_by(df: DataFrame, by: str | Sequence[str], name: str = "rows") -> DataFrame:
    return drop_null_keys(df, by).groupBy(*_names(by)).agg(F.count(F.lit(1)).alias(name))


def top_n(df: DataFrame, column: str, n: int, *ties: str, ascending: bool = False) -> DataFrame:
    """First ``n`` rows by a column, nulls last, ties settled by other columns."""
    key = F.col(column)
    order = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return df.orderBy(order, *ties).limit(n)


def last_n(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """Last ``n`` rows of the ascending order, nulls first: what a report's tail shows."""
    return df.orderBy(F.col(column).desc_nulls_last(), *(F.col(t).desc() for t in ties)).limit(n)


def non_null_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns holding at least one value: one aggregated row is fetched."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return []
    row = df.agg(*(F.count(c).alias(c) for c in present)).first()
    return [c for c in present if row[c] > 0]
