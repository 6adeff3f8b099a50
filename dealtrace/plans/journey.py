"""Channel sequences that led to won deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.aggregate import count_by, total
from ..operators.sweep import touch_prefixes

ARROW = " -> "


def journeys(
    opps: DataFrame,
    touches: DataFrame,
    won_only: bool = True,
    steps: int = 5,
) -> DataFrame:
    """One row per deal with the order in which channels touched its domain.

    All touches up to the deal's create date count, however old.
    """
    deals = opps.where(S.is_true("is_won")) if won_only else opps
    deals = deals.withColumn("domain", S.domain("domain"))
    known = touch_prefixes(deals, touches, steps, ["amount"])
    path = F.col("path")
    return known.select(
        "opp_id",
        "amount",
        F.col("touches").alias("n_touches"),
        F.col("channels").alias("n_channels"),
        path[0].alias("first_channel"),
        "last_channel",
        F.array_join(path, ARROW).alias("sequence"),
        F.array_join(F.slice(path, 1, 2), ARROW).alias("sequence_2ch"),
    )


def top_sequences(paths: DataFrame, n: int = 10) -> DataFrame:
    return (
        paths.groupBy("sequence_2ch")
        .agg(F.count("opp_id").alias("deals"), total("amount").alias("pipeline"))
        .orderBy(F.desc("deals"), "sequence_2ch")
        .limit(n)
    )


def first_channels(paths: DataFrame) -> DataFrame:
    return count_by(paths, "first_channel", "deals").orderBy(F.desc("deals"), "first_channel")
