"""Links as intervals: against all pairs, on ties, odd rows and a domain that owns nearly everything."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealtrace.operators import expand, intervals, link_touches, links_by_kind, sweep, touch_intervals
from dealtrace.plans import touch

T0 = dt.datetime(2024, 1, 1)
DEALS = "opp_id string, domain string, create_date timestamp, amount double"
TOUCHES = "domain string, touch_date timestamp, channel string"
WINDOW = 7


def random_case(seed):
    rng = random.Random(seed)

    def when():
        return T0 + dt.timedelta(hours=rng.randrange(24 * 40)) if rng.random() > 0.05 else None

    def domain():
        return rng.choice(["hot"] * 6 + ["a", "b", "c", None])

    deals = [(f"o{i % 110}", domain(), when(), float(i)) for i in range(120)]
    touches = [(domain(), when(), rng.choice(["x", "y", None])) for _ in range(500)]
    return deals, touches + touches[:40]


@pytest.mark.parametrize("seed, rows, block", [(1, 500_000, 4096), (2, 30, 8), (3, 7, 1)])
def test_intervals_equal_all_pairs(spark, monkeypatch, seed, rows, block):
    monkeypatch.setattr(sweep, "RANGE_ROWS", rows)
    monkeypatch.setattr(intervals, "BLOCK", block)
    deals, touches = random_case(seed)
    links = touch_intervals(spark.createDataFrame(deals, DEALS), spark.createDataFrame(touches, TOUCHES), WINDOW)
    placed = [(d, at, ch) for d, at, ch in touches if d is not None and at is not None]
    want = []
    for opp, domain, created, amount in deals:
        if domain is not None and created is not None:
            first = sum(d == domain and at < created - dt.timedelta(days=WINDOW) for d, at, _ in placed)
            want.append((opp, domain, created, amount, first, sum(d == domain and at <= created for d, at, _ in placed)))
    assert sorted(tuple(r) for r in links.deals.collect()) == sorted(want)
    numbered = links.touches.collect()
    assert len(numbered) == len(placed)
    for domain in {d for d, _, _ in placed}:
        own = sorted((r.place, r.touch_date) for r in numbered if r.domain == domain)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [at for _, at in own] == sorted(at for _, at in own)
    pairs = expand(links)
    assert pairs.columns == ["domain", "opp_id", "create_date", "amount", "touch_date", "channel", "days_before"]
    got = sorted(((r.opp_id, r.amount, r.touch_date, r.channel or "") for r in pairs.collect()))
    brute = [
        (opp, amount, at, ch or "")
        for opp, domain, created, amount in deals
        for d, at, ch in placed
        if d == domain and created is not None and dt.timedelta(0) <= created - at <= dt.timedelta(days=WINDOW)
    ]
    assert got == sorted(brute)


def test_a_domain_with_nearly_all_touches_and_deals(spark, monkeypatch):
    """A million touches and a hundred thousand deals of one domain: 10^10 pairs that nobody lists."""
    monkeypatch.setattr(sweep, "RANGE_ROWS", 50_000)
    second = lambda n: F.timestamp_micros(F.lit(1_700_000_000_000_000) + n * 1_000_000)
    touches = spark.range(1_000_000).select(
        F.when(F.col("id") % 100 > 0, "hot").otherwise("b").alias("domain"),
        second(F.pmod(F.xxhash64("id"), F.lit(3_000_000))).alias("touch_date"),
    )
    deals = spark.range(100_000).select(
        F.col("id").alias("opp_id"),
        F.lit("hot").alias("domain"),
        second(F.pmod(F.xxhash64(F.col("id") + 7), F.lit(3_000_000))).alias("create_date"),
    )
    seen, made = [], sweep.in_ranges
    monkeypatch.setattr(intervals, "in_ranges", lambda *a, **k: seen.append(made(*a, **k)) or seen[-1])
    links = touch_intervals(deals, touches, WINDOW)
    got = {r.opp_id: (r.first, r.after) for r in links.deals.collect()}
    dealt = seen[0].groupBy("range").count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    assert dealt[0] == 1_200_000 and dealt[1] < 150_000 and dealt[2] >= 20
    at = lambda df, c: np.array([r[0] for r in df.select(F.unix_micros(c)).collect()])
    times = np.sort(at(touches.where("domain = 'hot'"), "touch_date"))
    created = {r.opp_id: r.t for r in deals.select("opp_id", F.unix_micros("create_date").alias("t")).collect()}
    when = np.array([created[i] for i in range(100_000)])
    first = np.searchsorted(times, when - WINDOW * 86_400_000_000, "left")
    after = np.searchsorted(times, when, "right")
    assert [got[i] for i in range(100_000)] == list(zip(first.tolist(), after.tolist()))


def test_odd_tables(spark):
    deals = spark.createDataFrame([("o", "a", T0, 1.0)], DEALS)
    none = spark.createDataFrame([], TOUCHES)
    assert [(r.first, r.after) for r in touch_intervals(deals, none, WINDOW).deals.collect()] == [(0, 0)]
    assert link_touches(deals, none, WINDOW).count() == 0
    touches = spark.createDataFrame([("a", T0, "x"), (None, T0, "x"), ("a", None, "x")], TOUCHES)
    assert touch_intervals(spark.createDataFrame([], DEALS), touches, WINDOW).deals.count() == 0
    assert link_touches(deals, touches, 0).count() == 1


def test_expanding_joins_on_blocks(spark):
    deals, touches = random_case(4)
    plan = link_touches(spark.createDataFrame(deals, DEALS), spark.createDataFrame(touches, TOUCHES), WINDOW)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in text and "Join Inner, " in text
    assert not any(x in plan._jdf.queryExecution().executedPlan().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("read", [0, 4, 1000])
def test_links_by_kind_equal_all_pairs_read_or_swept(spark, monkeypatch, read):
    """No deal, some and all by their touches; deal ids repeat, so both ways may answer for one id."""
    monkeypatch.setattr(intervals, "READ_FOR_KIND", read)
    monkeypatch.setattr(intervals, "SHORT_BLOCK", 8)
    monkeypatch.setattr(sweep, "RANGE_ROWS", 50)
    deals, touches = random_case(4)
    rng = random.Random(5)
    touches = [(*t, rng.choice(["c1", "c2", None])) for t in touches]
    touches += touches[:50]
    ways, swept = [], intervals.swept
    monkeypatch.setattr(intervals, "swept", lambda asked, *a: ways.append(asked.count()) or swept(asked, *a))
    got = links_by_kind(
        spark.createDataFrame(deals, DEALS),
        spark.createDataFrame(touches, TOUCHES + ", campaign_id string"),
        ["channel", "campaign_id"],
        WINDOW,
        3,
    ).collect()
    want = {}
    for opp, domain, created, _ in deals:
        for d, at, channel, campaign in touches:
            if d is None or d != domain or None in (at, created) or not dt.timedelta(0) <= created - at <= dt.timedelta(days=WINDOW):
                continue
            us = round((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
            n, lo, hi, w = want.get((opp, channel, campaign), (0, us, us, 0.0))
            w += 2.0 ** (-(created - at) / dt.timedelta(days=3))
            want[opp, channel, campaign] = n + 1, min(lo, us), max(hi, us), w
    assert len(got) == len(want)
    for r in got:
        n, lo, hi, w = want[r.opp_id, r.channel, r.campaign_id]
        assert (r.touches, r.first_us, r.last_us) == (n, lo, hi) and r.weight == pytest.approx(w, rel=1e-9)
    assert bool(ways) == (read < 1000) and (read != 4 or 0 < ways[0] < len(deals) - 10)


def test_a_summary_lays_out_no_question_for_each_kind(spark, monkeypatch):
    """400 kinds in a domain, of which a deal's window holds a few."""
    laid = []
    for module in (sweep, intervals):
        lay_out = module.in_ranges
        monkeypatch.setattr(module, "in_ranges", lambda df, *a, f=lay_out, **k: laid.append(df.count()) or f(df, *a, **k))
    at = lambda hours: F.timestamp_seconds(F.lit(1_700_000_000) + hours * 3600)
    touches = spark.range(400).select(
        F.lit("hot").alias("domain"),
        at(F.col("id") * 2).alias("touch_date"),
        F.lit("x").alias("channel"),
        F.lit("t").alias("touch_type"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("campaign_id"),
    )
    deals = spark.range(100).select(
        F.col("id").cast("string").alias("opp_id"),
        F.lit("hot").alias("domain"),
        at(F.col("id") * 8 + 1).alias("create_date"),
        F.lit(1.0).alias("amount"),
    )
    got = touch.link_summary(deals, touches, None, 1, 3).groupBy("opp_id").count().collect()
    # Every other hour of a day: twelve; fewer at the beginning.
    assert {int(r.opp_id): r["count"] for r in got} == {i: min(12, 4 * i + 1) for i in range(100)}
    assert laid and max(laid) <= 400 + 2 * 100
