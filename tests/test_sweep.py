"""The pair-free touch operators against brute force over all pairs."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from dealtrace.operators import deal_channel_links, link_touches, sweep, touch_links, touch_prefixes

T0 = dt.datetime(2024, 1, 1)
DAY = 86_400_000_000
DEALS = "opp_id string, domain string, create_date timestamp, amount double"
TOUCHES = "domain string, touch_date timestamp, channel string"


def us(t):
    return round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def brute_links(deals, touches, window, half_life):
    out = defaultdict(lambda: [0, None, None, 0.0])
    for opp, domain, created, _ in deals:
        if domain is None or created is None:
            continue
        for d, at, channel in touches:
            age = us(created) - us(at) if at is not None else -1
            if d == domain and 0 <= age <= window * DAY:
                cell = out[opp, channel]
                cell[0] += 1
                cell[1] = us(at) if cell[1] is None else min(cell[1], us(at))
                cell[2] = us(at) if cell[2] is None else max(cell[2], us(at))
                cell[3] += 2.0 ** (-age / DAY / half_life)
    return {k: tuple(v) for k, v in out.items()}


def brute_paths(deals, touches, steps):
    out = {}
    for opp, domain, created, _ in deals:
        seen = sorted(
            (us(at), ch)
            for d, at, ch in touches
            if d is not None and d == domain and at is not None and (created is None or at <= created)
        )
        if not seen:
            continue
        names = [ch for _, ch in seen]
        path = [c for i, c in enumerate(names) if i == 0 or names[i - 1] != c]
        out[opp] = (len(seen), len(set(names)), path[:steps], names[-1])
    return out


def random_case(seed, hot):
    rng = random.Random(seed)

    def when():
        grain = rng.choice([dt.timedelta(hours=1), dt.timedelta(days=1), dt.timedelta(microseconds=1)])
        return T0 + grain * rng.randrange(int(dt.timedelta(days=40) / grain))

    def domain():
        return "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])

    deals = [(str(i), domain(), when() if rng.random() > 0.05 else None, 1.0) for i in range(60)]
    touches = [(domain(), when(), rng.choice("xyz")) for _ in range(400)]
    # Ties and both ends of the window.
    t = T0 + dt.timedelta(days=20)
    deals.append(("edge", "e", t, 1.0))
    for gap in (0, 7 * DAY, 7 * DAY + 1, -1, DAY, 3 * DAY):
        touches.append(("e", t - dt.timedelta(microseconds=gap), "x"))
    touches += [("e", t, "y"), ("e", t, "x"), ("e", None, "x"), (None, t, "x")]
    return deals, touches


@pytest.fixture(params=[sweep.RANGE_ROWS, 20])
def range_rows(request, monkeypatch):
    monkeypatch.setattr(sweep, "RANGE_ROWS", request.param)


@pytest.mark.parametrize("seed, hot, epoch", [(1, 0.0, 500), (2, 0.4, 500), (3, 0.9, 0.5), (4, 0.4, 3)])
def test_links_equal_brute_force(spark, monkeypatch, range_rows, seed, hot, epoch):
    monkeypatch.setattr(sweep, "EPOCH_HALF_LIVES", epoch)
    deals, touches = random_case(seed, hot)
    got = deal_channel_links(
        spark.createDataFrame(deals, DEALS),
        spark.createDataFrame(touches, TOUCHES),
        window_days=7,
        half_life_days=3,
        carry=["amount"],
    ).collect()
    want = brute_links(deals, touches, 7, 3)
    assert {(r.opp_id, r.channel) for r in got} == set(want)
    for r in got:
        n, lo, hi, weight = want[r.opp_id, r.channel]
        assert (r.touches, r.first_us, r.last_us, r.amount) == (n, lo, hi, 1.0)
        assert r.weight == pytest.approx(weight, rel=1e-9)


@pytest.mark.parametrize("seed, hot", [(5, 0.0), (6, 0.5)])
def test_pairs_equal_brute_force(spark, seed, hot):
    deals, touches = random_case(seed, hot)
    pairs = link_touches(spark.createDataFrame(deals, DEALS), spark.createDataFrame(touches, TOUCHES), 7)
    got = defaultdict(int)
    for r in pairs.collect():
        got[r.opp_id, r.channel] += 1
        assert 0 <= r.days_before <= 7
    assert dict(got) == {k: v[0] for k, v in brute_links(deals, touches, 7, 3).items()}


@pytest.mark.parametrize("seed, hot", [(7, 0.0), (8, 0.6), (9, 0.3)])
def test_prefixes_equal_brute_force(spark, range_rows, seed, hot):
    deals, touches = random_case(seed, hot)
    rows = touch_prefixes(
        spark.createDataFrame(deals, DEALS),
        spark.createDataFrame(touches, TOUCHES),
        steps=5,
        carry=["amount"],
    ).collect()
    got = {r.opp_id: (r.touches, r.channels, r.path, r.last_channel) for r in rows}
    assert got == brute_paths(deals, touches, 5)


def test_links_by_several_columns(spark):
    deals, touches = random_case(11, 0.4)
    rng = random.Random(1)
    touches = [(*t, rng.choice(["c1", None])) for t in touches]
    got = touch_links(
        spark.createDataFrame(deals, DEALS),
        spark.createDataFrame(touches, TOUCHES + ", campaign_id string"),
        ["channel", "campaign_id"],
        7,
        3,
    ).collect()
    want = brute_links(deals, [(d, at, (ch, c)) for d, at, ch, c in touches], 7, 3)
    assert {(r.opp_id, (r.channel, r.campaign_id)): r.touches for r in got} == {k: v[0] for k, v in want.items()}


def test_no_group_is_larger_than_a_range(spark, monkeypatch):
    """One domain, one channel, one day, half of the touches at one instant, most deals at another."""
    monkeypatch.setattr(sweep, "RANGE_ROWS", 20_000)
    day = 1_700_000_000
    touches = spark.range(400_000).select(
        F.lit("hot").alias("domain"),
        F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.lit(day)))
        .otherwise(F.timestamp_micros(F.lit(day * 1_000_000) + F.pmod(F.xxhash64("id"), F.lit(DAY))))
        .alias("touch_date"),
        F.lit("x").alias("channel"),
    )
    deals = spark.range(60_000).select(
        F.col("id").cast("string").alias("opp_id"),
        F.lit("hot").alias("domain"),
        F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.lit(day + 80_000))).alias("create_date"),
        F.lit(1.0).alias("amount"),
    )
    seen = []
    made = sweep.in_ranges
    monkeypatch.setattr(sweep, "in_ranges", lambda *a, **k: seen.append(made(*a, **k)) or seen[-1])
    links = deal_channel_links(deals, touches, 365, 30).groupBy("touches").count().collect()
    paths = touch_prefixes(deals, touches).groupBy("touches", F.isnotnull("last_channel").alias("k")).count().collect()
    assert len(links) == 1 and links[0]["count"] == 20_000
    assert sorted((r.touches, r["count"]) for r in paths) == [(links[0].touches, 20_000), (400_000, 40_000)]
    for df in seen:
        assert df.groupBy("range").count().agg(F.max("count")).first()[0] < 2 * 20_000


def test_empty_inputs_keep_their_schema(spark):
    deals, touches = spark.createDataFrame([], DEALS), spark.createDataFrame([], TOUCHES)
    links = deal_channel_links(deals, touches, 7, 3, ["amount"])
    assert links.columns == ["opp_id", "amount", "channel", "touches", "first_us", "last_us", "weight"]
    assert links.count() == 0
    assert touch_prefixes(deals, touches).count() == 0
    assert link_touches(deals, touches, 7).count() == 0


def test_hot_domain_counts_are_exact(spark):
    """A third of both tables in one domain: hundreds of millions of pairs, counted
    without listing them, equal to a sorted search."""
    import numpy as np
    from pyspark.sql import functions as F

    def table(rows, seed, name):
        spread = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2 * 365 * 86_400))
        domain = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 97))
        return spark.range(rows).select(
            F.col("id").cast("string").alias("opp_id"),
            domain.alias("domain"),
            F.timestamp_seconds(spread + 1_600_000_000).alias(name),
            F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("channel"),
        )

    deals = table(30_000, 1, "create_date").drop("channel")
    touches = table(60_000, 2, "touch_date").drop("opp_id")
    got = deal_channel_links(deals, touches, 365, 30).join(deals, "opp_id").where("domain = 'hot'")
    n, pairs = got.agg(F.countDistinct("opp_id"), F.sum("touches")).first()

    def seconds(df, name):
        rows = df.where("domain = 'hot'").select(F.unix_micros(name).alias("s")).toPandas()
        return np.sort(rows["s"].to_numpy())

    at, seen = seconds(deals, "create_date"), seconds(touches, "touch_date")
    inside = np.searchsorted(seen, at, "right") - np.searchsorted(seen, at - 365 * DAY, "left")
    assert (n, pairs) == (int((inside > 0).sum()), int(inside.sum()))
    assert pairs > 5e7
