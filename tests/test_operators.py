import pytest
from pyspark.sql import functions as F

from dealtrace.operators import (
    deal_summary,
    engagement_rates,
    latest_state,
    last_n,
    non_null_columns,
    pivot_sum,
    pre_aggregate_deals,
    ranked_pivot,
    stack_columns,
    top_n,
)
from dealtrace.operators.aggregate import summarise_totals, total

LOG = "id string, version double, value string, other string"


def test_latest_state_merges_per_column(spark):
    rows = [("a", 1.0, "p", "k"), ("a", 2.0, None, "l"), ("b", 1.0, "q", None), ("b", None, "r", None), (None, 9.0, "z", "z")]
    log = spark.createDataFrame(rows, LOG)
    merged = {r.id: (r.value, r.other) for r in latest_state(log, ["id"], "version").collect()}
    assert merged == {"a": ("p", "l"), "b": ("r", None)}
    last = {r.id: (r.value, r.other) for r in latest_state(log, ["id"], "version", mode="row").collect()}
    assert last == {"a": (None, "l"), "b": ("r", None)}


def test_latest_state_ties_are_settled_by_columns(spark):
    rows = [("a", 1.0, "p", "1"), ("a", 1.0, "q", "2")]
    for order in (rows, rows[::-1]):
        log = spark.createDataFrame(order, LOG)
        assert latest_state(log, ["id"], "version", ["other"]).first().value == "q"
    with pytest.raises(ValueError):
        latest_state(log, ["id"], "version", mode="best")


DEALS = "opp_id string, account_id string, k string, amount double, is_won boolean"
ROWS = [
    ("1", "A", "x", 10.0, True),
    ("2", "A", "x", None, None),
    ("3", "B", "x", 5.0, False),
    ("4", "B", "y", None, True),
    ("5", "B", None, 7.0, True),
]


def test_deal_summary(spark):
    got = {r.k: r for r in deal_summary(spark.createDataFrame(ROWS, DEALS), "k").collect()}
    assert set(got) == {"x", "y"}
    assert (got["x"].deals, got["x"].won, got["x"].pipeline, got["x"].won_pipeline) == (3, 1, 15.0, 10.0)
    assert got["x"].avg_deal == 7.5 and got["x"].win_rate == 1 / 3
    assert got["y"].pipeline == 0.0 and got["y"].avg_deal is None


def test_pre_aggregated_totals_give_the_same_summary(spark):
    deals = spark.createDataFrame(ROWS, DEALS)
    direct = deal_summary(deals, "k").collect()
    summed = summarise_totals(pre_aggregate_deals(deals, ["account_id", "k"]), "k")
    assert sorted(map(tuple, direct)) == sorted(map(tuple, summed.collect()))


def test_engagement_rates(spark):
    rows = [("a", True, False, False), ("a", False, True, False), ("b", False, False, True)]
    df = spark.createDataFrame(rows, "k string, is_open boolean, is_click boolean, is_register boolean")
    got = {r.k: r for r in engagement_rates(df, "k").collect()}
    assert (got["a"].open_rate, got["a"].click_rate, got["a"].click_to_open) == (0.5, 0.5, 1.0)
    assert got["b"].click_to_open is None and got["b"].register_rate == 1.0
    assert engagement_rates(df).first().events == 3


def test_top_n_puts_nulls_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0), ("d", 2.0)], "k string, v double")
    assert [r.k for r in top_n(df, "v", 3, "k").collect()] == ["c", "d", "b"]


def test_last_n_of_an_ordered_report(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0), ("d", 2.0)], "k string, v double")
    assert [r.k for r in last_n(df, "v", 2, "k").collect()] == ["d", "c"]


def test_non_null_columns(spark):
    df = spark.createDataFrame([(None, 1), (None, None)], "a string, b int")
    assert non_null_columns(df, ["a", "b", "missing"]) == ["b"]


def test_pivots_and_stack(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "x", 2.0), ("s", "y", 9.0)], "a string, b string, v double")
    wide = {r.a: (r.x, r.y) for r in pivot_sum(df, "a", "b", "v", ["x", "y"]).collect()}
    assert wide == {"r": (3.0, 0.0), "s": (0.0, 9.0)}
    # Values that are not listed keep their money, in a column of their own or in Other.
    part = {r.a: (r.x, r.Other) for r in pivot_sum(df, "a", "b", "v", ["x"]).collect()}
    assert part == {"r": (3.0, 0.0), "s": (0.0, 9.0)}
    assert pivot_sum(df, "a", "b", "v").columns == ["a", "x", "y"]
    top = ranked_pivot(df, "a", "b", "v", ["x"], 1).first()
    assert (top.a, top.row_total) == ("s", 9.0)
    assert [r.a for r in ranked_pivot(df, "a", "b", "v", ["x", "y"], 1).collect()] == ["s"]
    long = stack_columns(spark.createDataFrame([(1, 2.0, 3.0)], "i int, p double, q double"), ["i"], ["p", "q"], "n", "v")
    assert sorted((r.n, r.v) for r in long.collect()) == [("p", 2.0), ("q", 3.0)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A key owning most rows leaves each map task as one row."""
    hot = spark.range(200_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").cast("double").alias("version"),
        F.col("id").cast("string").alias("value"),
    )
    last = latest_state(hot, ["id"], "version", ["value"])
    assert last.where("id = 'hot'").first().value == "199999"
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_totals_keep_their_cents_in_any_order(spark):
    rows = spark.range(400_000).select("id", (F.col("id") * 97_003_111 % 50_000_000_000 / 100).alias("amount"))
    want = sum(i * 97_003_111 % 50_000_000_000 for i in range(400_000)) / 100
    for order in (F.asc("id"), F.desc("amount"), F.asc("amount")):
        got = rows.coalesce(1).sortWithinPartitions(order).agg(total("amount")).first()[0]
        assert abs(got - want) < 0.0005
    few = spark.createDataFrame([(None, 2, float("inf")), (None, 3, 1.0)], "a double, b long, c double")
    assert tuple(few.agg(total("a"), total("b", "bigint"), total("c")).first()) == (0.0, 5, float("inf"))
