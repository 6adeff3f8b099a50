"""Reconciliation: headline totals recomputed and compared.

What each table adds to the checks is a set of plain aggregates (:func:`measures`).
They can be computed from tables (:func:`reconcile`), or by the tasks that write
the tables, as observed metrics (:func:`keep_measured`); then the comparison reads
no table at all (:func:`reconcile_totals`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import scalars as S
from ..operators.aggregate import total
from ..sources.scratch import keep

UNIQUE = "unique opportunities"
CHANNEL_PIPE, CHANNEL_WON, CHANNEL_COUNT = (
    "channel pipeline vs opportunities",
    "channel won revenue vs opportunities",
    "channel won count vs opportunities",
)
ACCOUNT_PIPE, REPORT_WON, REPORT_COUNT = (
    "account pipeline vs opportunities",
    "report won revenue vs channels",
    "report won count vs channels",
)
TOUCH_PIPE, TOUCH_WON = "influenced vs first-touch pipeline", "influenced vs first-touch won"
STAGES = {stage: f"funnel stage {stage}" for stage in V.FUNNEL_STAGES}
EXACT = [UNIQUE, CHANNEL_COUNT, REPORT_COUNT, *STAGES.values()]
TABLES = ("opps", "channels", "master", "report", "funnel", "attribution", "campaign", "ads", "email", "web")


def measures(table: str) -> dict[tuple[str, str], Column]:
    """(side, check) to the aggregate that ``table`` adds to it; several tables' parts of one are summed.

    The funnel's stages are counted anew from the tables, flags summed as numbers, not by the
    funnel's own functions.  Distinct deals are not here: see :func:`distinct_deals`.
    """

    def flagged(condition: str) -> Column:
        return F.expr(f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)")

    def added(column: str) -> Column:
        return F.expr(f"sum(`{column}`)")

    def recounted(*parts: tuple[int, Column]) -> dict[tuple[str, str], Column]:
        return {("expected", STAGES[V.FUNNEL_STAGES[place]]): value for place, value in parts}

    def credit(model: str, column: str) -> Column:
        return total(F.when(F.col("attribution_model") == model, F.col(column)))

    won = S.is_true("is_won")
    if table == "opps":
        of_all, of_won, n_won = total("amount"), total(F.when(won, F.col("amount"))), F.count_if(won)
        return {
            ("actual", UNIQUE): F.count(F.lit(1)),
            ("expected", CHANNEL_PIPE): of_all,
            ("expected", CHANNEL_WON): of_won,
            ("expected", CHANNEL_COUNT): n_won,
            ("expected", ACCOUNT_PIPE): of_all,
            **recounted(
                (5, F.expr("count(*)")),
                (6, flagged("is_marketing_sourced")),
                (7, flagged("is_won")),
                (8, flagged("is_marketing_sourced AND is_won")),
            ),
        }
    if table == "channels":
        return {
            ("actual", CHANNEL_PIPE): total("total_pipeline"),
            ("actual", CHANNEL_WON): total("won_pipeline"),
            ("actual", CHANNEL_COUNT): total("won_count"),
            ("expected", REPORT_WON): total("won_pipeline"),
            ("expected", REPORT_COUNT): total("won_count"),
        }
    if table == "report":
        return {("actual", REPORT_WON): total("won_revenue"), ("actual", REPORT_COUNT): total("won_deals")}
    if table == "master":
        return {("actual", ACCOUNT_PIPE): total("total_pipeline")}
    if table == "attribution":
        return {
            ("actual", TOUCH_PIPE): credit(V.INFLUENCED, "attributed_pipeline"),
            ("actual", TOUCH_WON): credit(V.INFLUENCED, "attributed_won"),
            ("expected", TOUCH_PIPE): credit(V.FIRST_TOUCH, "attributed_pipeline"),
            ("expected", TOUCH_WON): credit(V.FIRST_TOUCH, "attributed_won"),
        }
    if table == "funnel":
        of = lambda stage: F.sum(F.when(F.col("stage") == stage, F.col("count").cast("bigint")))
        return {("actual", check): of(stage) for stage, check in STAGES.items()}
    if table == "campaign":
        return recounted((0, added("impressions")), (1, added("clicks")), (2, added("form_fills")))
    if table == "ads":
        return recounted((0, added("impressions")), (1, added("clicks")))
    if table == "web":
        return recounted((2, flagged("is_goal_completed")))
    if table == "email":
        return recounted((3, F.expr("count(*)")), (4, flagged("is_click")))
    raise ValueError(f"no checks on {table!r}")


def distinct_deals(opps: DataFrame) -> Column:
    """Distinct deals, which tasks cannot sum up on their own."""
    return F.countDistinct("opp_id")


def _verdicts(rows: DataFrame, tolerance: float) -> DataFrame:
    """check, actual, expected, ok from (check, side, value); a side that nothing was added to is null and fails."""

    def side(name: str) -> Column:
        return F.sum(F.when(F.col("side") == name, F.col("value"))).alias(name)

    gap = F.abs(F.col("actual") - F.col("expected"))
    allowed = F.when(F.col("check").isin(EXACT), F.lit(0.0)).otherwise(F.lit(tolerance))
    recounted = F.col("check").isin(list(STAGES.values()))
    both = rows.groupBy("check").agg(side("actual"), side("expected"))
    # A stage without any row was counted, as nothing.
    both = both.withColumn("expected", F.when(recounted, F.coalesce("expected", F.lit(0.0))).otherwise(F.col("expected")))
    return both.withColumn("ok", F.coalesce(gap <= allowed, F.lit(False)))


def keep_measured(df: DataFrame, table: str, label: str) -> tuple[DataFrame, dict[tuple[str, str], float | None]]:
    """``df`` as a written table, and its :func:`measures` as the writing tasks saw them; it is not read for them."""
    wanted = measures(table)
    seen = Observation()
    named = [value.cast("double").alias(f"m{i}") for i, value in enumerate(wanted.values())]
    stored = keep(df.observe(seen, *named), label)
    found = seen.get
    return stored, {key: found.get(f"m{i}") for i, key in enumerate(wanted)}


def keep_all_measured(
    tables: Mapping[str, DataFrame], label: str = "stage"
) -> tuple[dict[str, DataFrame], dict[str, dict[tuple[str, str], float | None]]]:
    """:func:`keep_measured` of several tables, one after another."""
    done = {name: keep_measured(df, name, f"{label}-{name}") for name, df in tables.items()}
    return {name: df for name, (df, _) in done.items()}, {name: found for name, (_, found) in done.items()}


def reconcile_totals(
    spark: SparkSession, totals: Mapping[str, Mapping[tuple[str, str], float | None]], tolerance: float = V.TOLERANCE
) -> DataFrame:
    """check, actual, expected, ok from totals by table, as :func:`keep_measured` returns them."""
    rows = [(check, side, value) for found in totals.values() for (side, check), value in found.items()]
    return _verdicts(spark.createDataFrame(rows, "check string, side string, value double"), tolerance)


def reconcile(
    opps: DataFrame,
    channels: DataFrame,
    master: DataFrame,
    report: DataFrame,
    funnel: DataFrame,
    attribution: DataFrame,
    campaign: DataFrame,
    ads: DataFrame,
    email: DataFrame,
    web: DataFrame,
    tolerance: float = V.TOLERANCE,
) -> DataFrame:
    """check, actual, expected, ok: every check in one table, none raises; one pass over each table.

    Each table is reduced to one row of totals; the rows are stacked and paired
    by check name.
    """
    frames = (opps, channels, master, report, funnel, attribution, campaign, ads, email, web)
    parts = []
    for table, df in zip(TABLES, frames):
        wanted = measures(table)
        if table == "opps":
            wanted[("expected", UNIQUE)] = distinct_deals(df)
        named = {f"m{i}": value.cast("double") for i, value in enumerate(wanted.values())}
        row = df.agg(*(value.alias(name) for name, value in named.items()))
        keys = F.array(
            *(
                F.struct(F.lit(check).alias("check"), F.lit(side).alias("side"), F.col(name).alias("value"))
                for (side, check), name in zip(wanted, named)
            )
        )
        parts.append(row.select(F.inline(keys)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _verdicts(rows, tolerance)
