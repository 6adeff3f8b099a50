import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealtrace.catalog.queries import Tables, _attribution, _channels, _master
from dealtrace.functions import fixed_values as V
from dealtrace.plans import channel as C
from dealtrace.plans import forest as R
from dealtrace.plans import winprob as W
from dealtrace.plans.funnel import funnel
from dealtrace.catalog.queries import QUERIES
from dealtrace.plans import quality as N
from dealtrace.plans.quality import reconcile

FOLDER = "/root/testdata/sf0.001"


def checks(t, **changed):
    channels = _channels(t)
    parts = {
        "opps": t.opps,
        "channels": channels,
        "master": _master(t),
        "report": C.channel_roi_report(channels),
        "funnel": funnel(t.campaign, t.ads, t.email, t.web, t.opps),
        "attribution": _attribution(t, V.INFLUENCED, V.FIRST_TOUCH),
        "campaign": t.campaign,
        "ads": t.ads,
        "email": t.email,
        "web": t.web,
    }
    return {r.check: r.ok for r in reconcile(**{**parts, **changed}).collect()}


def test_all_eighteen_checks_pass(spark):
    got = checks(Tables(spark, FOLDER))
    assert len(got) == 18 and all(got.values())


def test_observed_totals_equal_computed_ones(spark):
    t = Tables(spark, FOLDER)
    channels = _channels(t)
    tables = {"opps": t.opps, "web": t.web, "channels": channels, "report": C.channel_roi_report(channels)}
    tables["email"] = t.email.where("false")
    stored, totals = N.keep_all_measured(tables)
    for name, df in tables.items():
        assert stored[name].count() == df.count() and stored[name].columns == df.columns
        wanted = N.measures(name)
        row = stored[name].agg(*(v.cast("double").alias(f"m{i}") for i, v in enumerate(wanted.values()))).first()
        assert totals[name].keys() == wanted.keys()
        for value, plain in zip(totals[name].values(), row):
            assert value == pytest.approx(plain, rel=1e-12) if plain is not None else value is None


def test_reconciliation_reads_no_table_for_the_comparison(spark):
    df = QUERIES["reconciliation"](spark, FOLDER)
    assert df.where("ok").count() == 18
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "Scan ExistingRDD" in plan


def test_every_wrong_total_fails_its_own_check(spark):
    sides = {}
    for table in N.TABLES:
        for i, (side, check) in enumerate(N.measures(table)):
            sides.setdefault(table, {})[side, check] = 3.0 if check.startswith("funnel") else 7.0
    sides["opps"]["expected", N.UNIQUE] = 7.0
    # Impressions, clicks and form fills are recounted from two tables each.
    for place in (0, 1, 2):
        sides["funnel"]["actual", N.STAGES[V.FUNNEL_STAGES[place]]] = 6.0
    good = {r.check: r.ok for r in N.reconcile_totals(spark, sides).collect()}
    assert len(good) == 18 and all(good.values())
    every = [(table, key) for table, found in sides.items() for key in found]
    for i, (table, (side, check)) in enumerate(every):
        if i % 3 and not check.startswith("funnel stage " + V.FUNNEL_STAGES[0]):
            continue
        wrong = None if i % 2 and table != "opps" else sides[table][side, check] + 1
        changed = {**sides, table: {**sides[table], (side, check): wrong}}
        got = {r.check: r.ok for r in N.reconcile_totals(spark, changed).collect()}
        assert [k for k, ok in got.items() if not ok] == [check]
    gap = {**sides, "master": {("actual", N.ACCOUNT_PIPE): 7.009}}
    assert all(r.ok for r in N.reconcile_totals(spark, gap).collect())


def test_a_lost_deal_is_reported(spark):
    t = Tables(spark, FOLDER)
    fewer = _master(t).where(F.col("account_id") != "1")
    twice = t.opps.unionByName(t.opps)
    assert not checks(t, master=fewer)["account pipeline vs opportunities"]
    assert not checks(t, opps=twice)["unique opportunities"]


@pytest.fixture(scope="module")
def planted(spark):
    """Won depends on tier and intent; half the deals are open."""
    deals = spark.range(2_000).select(
        F.col("id").cast("string").alias("opp_id"),
        F.lit("n").alias("account_name"),
        (F.col("id") % 100).cast("double").alias("amount"),
        F.lit("sales").alias("channel_category"),
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("S"), (F.col("id") % 3).cast("string"))).alias("segment"),
        F.when(F.col("id") % 4 == 3, "Rare").when(F.col("id") % 2 == 0, "Gold").otherwise("Tin").alias("tier"),
        (F.xxhash64("id") % 50 + 50).cast("double").alias("intent_score"),
        F.when(F.col("id") % 4 >= 2, "Open").otherwise("Closed").alias("stage"),
    )
    won = (F.col("tier") == "Gold") & (F.col("intent_score") > 30)
    deals = deals.withColumn("is_won", won)
    return deals.withColumns({"is_closed_deal": F.col("stage") == "Closed", "label": won.cast("double")})


def test_win_model(planted):
    model = W.fit_win_model(planted, trees=15, depth=4)
    assert model.features == ("channel_category", "segment", "tier", "intent_score", "amount")
    scored = W.score_open(model, planted)
    assert scored.count() == planted.where("stage = 'Open'").count()
    low, high = scored.agg(F.min("win_probability"), F.max("win_probability")).first()
    assert 0.0 <= low < 0.5 < high <= 1.0
    top = W.feature_importance(model, planted).collect()
    assert {top[0].feature, top[1].feature} == {"tier", "intent_score"}
    assert sum(r.importance for r in top) == pytest.approx(1.0)
    assert W.training_accuracy(model, planted).first().accuracy > 0.9
    assert W.win_histogram(scored).agg(F.sum("deals")).first()[0] == scored.count()


def test_cross_validation(planted):
    mean, spread = W.cross_validated_auc(planted, folds=3, trees=5, depth=3)
    assert mean > 0.8 and 0.0 <= spread < 0.2


def test_scores_in_a_session_that_observed_totals(planted):
    N.keep_measured(planted.select("amount", "is_won").limit(5).withColumnsRenamed({"amount": "total_pipeline"}), "master", "seen")
    model = W.fit_win_model(planted, trees=3, depth=2)
    assert W.score(model, planted).agg(F.count("win_probability")).first()[0] == planted.count()
    assert W.out_of_fold_scores(planted, folds=2, trees=2, depth=2).count() == planted.where("is_closed_deal").count()


def test_the_forest_is_the_same_however_rows_are_dealt(planted):
    found = []
    for parts in (1, 7):
        model = W.fit_win_model(planted.repartition(parts), trees=4, depth=3)
        found.append({c: v.tolist() for c, v in model.forest.nodes.items()})
    assert found[0] == found[1]
    nodes = list(zip(*(found[0][c] for c in ("tree", "node", "place", "left", "right", "n", "won"))))
    by = {(t, x): (n, won) for t, x, _, _, _, n, won in nodes}
    for t, x, place, left, right, n, won in nodes:
        if place >= 0:
            assert (by[t, left][0] + by[t, right][0], by[t, left][1] + by[t, right][1]) == (n, won)
            assert min(by[t, left][0], by[t, right][0]) >= V.WIN_MIN_LEAF
    closed = planted.where("is_closed_deal").count()
    assert all(abs(by[t, 0][0] / closed - 1) < 0.15 for t in range(4))


def test_counts_of_a_task_equal_those_row_by_row(monkeypatch):
    """Spark's small batches are counted as larger ones: as many walks as these, and the same counts."""
    monkeypatch.setattr(R, "ROWS", 40)
    rng = np.random.default_rng(3)
    names, cuts = ["a", "b", "c"], [np.array([0.5, 1.5]), np.array([]), np.array([0.25, 0.5, 0.75])]
    n = 150
    columns = [rng.integers(0, 3, n).astype(float), np.full(n, 7.0), rng.random(n)]
    label, salt = rng.integers(0, 2, n).astype(float), rng.integers(-(2**62), 2**62, n)
    table = pa.table([*map(pa.array, columns), pa.array(label), pa.array(salt)], [*names, R.LABEL, R.SALT])
    # Node 0 tests c, its right child a; node 1 and the last two are leaves, of which 3 and 4 are open.
    parts = [("place", [2, -1, 0, -1, -1]), ("threshold", [0.5, 0.0, 0.5, 0.0, 0.0]), ("left", [1, 0, 3, 0, 0]), ("n", [1.0] * 5), ("won", [0.0] * 5)]
    nodes = {"tree": np.zeros(5, int), **{k: np.array(v) for k, v in parts}}
    slots, tried = np.array([-1, -1, -1, 0, 1]), np.array([[0, 2], [1, 2]])
    tables, walks = R._tables(nodes, cuts), []
    walked = R._walked
    monkeypatch.setattr(R, "_walked", lambda *a: walks.append(1) or walked(*a))
    out = list(R._counter(names, cuts, tables, 2, {0: (slots, tried)}, 42)(table.to_batches(max_chunksize=7)))
    got = np.frombuffer(out[0].column("counts")[0].as_buffer(), float).reshape(2, 2, 2, R.BINS)
    want = np.zeros((2, 2, 2, R.BINS))
    mixed = R._mix(salt.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (1 + (42 << 20))) % 2**64)) >> np.uint64(48)
    for i, drawn in enumerate(R._draws()[mixed].tolist()):
        if columns[2][i] > 0.5:
            slot = int(columns[0][i] > 0.5)
            for k, f in enumerate(tried[slot]):
                want[k, slot, int(label[i]), np.searchsorted(cuts[f], columns[f][i])] += drawn
    assert (got == want).all() and want.sum() > 50 and len(walks) == 4


def test_forests_that_grow_together_are_those_that_grow_alone(planted, monkeypatch):
    """Folds are read in one pass a level, and each forest is the one of its own rows."""
    model, closed = W._encoder(W.stratified_folds(planted, 3), ["channel_category"], ["amount"])
    rows, codes = W._training(model, closed), W._codes(model)
    alone = [R.fit_forest(rows.where(F.col(W.FOLD) != fold), codes, 6, 4, 5, 1) for fold in range(3)]
    passes, counter = [], R._counter
    monkeypatch.setattr(R, "_counter", lambda *a, **k: passes.append(1) or counter(*a, **k))
    monkeypatch.setattr(R, "ROWS", 50)
    together = R.fit_forests(rows, codes, 6, 4, 5, 1, [0, 1, 2], W.FOLD)
    assert 1 < len(passes) <= 4
    for a, b in zip(alone, together, strict=True):
        assert {c: v.tolist() for c, v in a.nodes.items()} == {c: v.tolist() for c, v in b.nodes.items()}
    assert together[0].nodes["n"].tolist() != together[1].nodes["n"].tolist()


def test_folds_are_fitted_to_the_stored_deals(planted, tmp_path):
    folder = W.store_win_model(planted, str(tmp_path), "a", trees=2, depth=2)
    stored = W.stored(planted.sparkSession, folder, "deals")
    fit = {"folds": 2, "trees": 2, "depth": 2}
    assert stored.count() == planted.count()
    assert W.cross_validated_auc(stored, **fit) == pytest.approx(W.cross_validated_auc(planted, **fit), abs=1e-12)


@pytest.mark.parametrize("most", [0, 200, 60_000, 70_000])
def test_counts_are_sent_in_few_bytes_and_stay_whole(most):
    counts = np.array([0, 1, most], float)
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([counts.tobytes()])], ["tree", "counts"])
    packed = next(R._packed(iter)([batch])).column("counts")[0].as_buffer()
    assert np.frombuffer(packed, f"u{packed.size // 3}").tolist() == counts.tolist()
    assert packed.size <= 12


def test_a_model_makes_its_deals_once(planted, tmp_path):
    seen = planted.sparkSession.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    W.store_win_model(planted.withColumn("amount", told("amount")), str(tmp_path), "a", trees=2, depth=2)
    assert seen.value == planted.count()


def test_importance_from_the_nodes_equals_the_fitted_one(planted, tmp_path):
    model = W.fit_win_model(planted, trees=12, depth=5)
    nodes = W.forest_nodes(planted.sparkSession, model.save(str(tmp_path)))
    got = {r.feature: r.importance for r in W.node_importance(nodes).collect()}
    want = {r.feature: r.importance for r in W.feature_importance(model, planted).collect() if r.importance > 0}
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-12) for f in want)
    rows = nodes.collect()
    inner = {(r.tree, r.node): r for r in rows if r.feature is not None}
    by = {(r.tree, r.node): r for r in rows}
    assert all(by[t, r.left].n + by[t, r.right].n == r.n for (t, _), r in inner.items())
    assert {r.tree for r in rows} == set(range(12))


def test_areas_equal_the_share_of_ordered_pairs(spark):
    rng = random.Random(2)
    rows = [(f, float(rng.random() < 0.3 + f / 10), rng.randrange(12) * 1000) for f in range(3) for _ in range(200)]
    rows += [(3, 1.0, 5), (3, 1.0, 9)]  # a fold with one label only
    got = {r.fold: r.auc for r in W.fold_auc(spark.createDataFrame(rows, "fold int, label double, steps long")).collect()}
    for f in range(3):
        won = [s for g, y, s in rows if g == f and y]
        lost = [s for g, y, s in rows if g == f and not y]
        pairs = sum((a > b) + (a == b) / 2 for a in won for b in lost)
        assert got[f] == pytest.approx(pairs / len(won) / len(lost), abs=1e-12)
    assert got[3] is None


def test_no_deal_is_scored_by_a_forest_that_saw_it(planted):
    scores = W.out_of_fold_scores(planted, folds=3, trees=4, depth=3).collect()
    assert len(scores) == planted.where("is_closed_deal").count() and {r.fold for r in scores} == {0, 1, 2}
    assert all(0 <= r.steps <= W.SCORE_STEPS for r in scores)


def test_stored_models_keep_their_versions(planted, tmp_path):
    spark = planted.sparkSession
    first = W.store_win_model(planted, str(tmp_path), "a", trees=3, depth=2)
    second = W.store_win_model(planted.where("opp_id % 3 > 0"), str(tmp_path), "b", trees=2, depth=2)
    assert first < second
    scores = W.stored(spark, first, "scores")
    assert scores.count() == planted.count() and "key" not in scores.columns
    loaded = W.load_win_model(spark, first)
    want = {(r.opp_id, r.win_probability) for r in W.score(loaded, planted).collect()}
    assert {(r.opp_id, r.win_probability) for r in scores.collect()} == want
    ready = spark.read.parquet(f"{tmp_path}/*/ready").collect()
    assert {(r.key, r.version) for r in ready} == {("a", first.rsplit("/")[-1]), ("b", second.rsplit("/")[-1])}
    assert W.stored(spark, second, "nodes").select("tree").distinct().count() == 2


def test_one_schema_whatever_is_open(planted, tmp_path):
    closed = planted.where("is_closed_deal")
    model = W.fit_win_model(closed, trees=3, depth=2)
    scored = W.score_open(model, closed, "closed")
    nothing = W.score_open(model, closed)
    assert scored.count() == closed.count() and nothing.count() == 0
    assert scored.schema == nothing.schema and "is_won" in scored.columns
    # Ranked, and the same after saving and loading.
    model.save(str(tmp_path))
    again = W.score_open(W.load_win_model(planted.sparkSession, str(tmp_path)), closed, "closed")
    chances = [(r.opp_id, r.win_probability) for r in scored.collect()]
    assert chances == [(r.opp_id, r.win_probability) for r in again.collect()]
    assert [p for _, p in chances] == sorted((p for _, p in chances), reverse=True)


def test_folds_hold_both_labels_in_their_share(planted):
    counts = {(r[W.FOLD], r.label): r["count"] for r in W.stratified_folds(planted).groupBy(W.FOLD, "label").count().collect()}
    totals = {y: sum(n for (_, l), n in counts.items() if l == y) for y in (0.0, 1.0)}
    assert {f for f, _ in counts} == set(range(5))
    assert all(abs(n - totals[y] / 5) <= 10 for (_, y), n in counts.items())


def test_every_damaged_table_is_reported(spark):
    t = Tables(spark, FOLDER)
    good = funnel(t.campaign, t.ads, t.email, t.web, t.opps)
    for stage in V.FUNNEL_STAGES:
        off = good.withColumn("count", F.when(F.col("stage") == stage, F.col("count") + 1).otherwise(F.col("count")))
        got = checks(t, funnel=off)
        assert [k for k, ok in got.items() if not ok] == [f"funnel stage {stage}"]
    credits = _attribution(t, V.INFLUENCED, V.FIRST_TOUCH)
    more = credits.withColumn("attributed_pipeline", F.col("attributed_pipeline") + 1)
    fewer = more.where(F.col("attribution_model") != V.INFLUENCED)
    assert not checks(t, attribution=fewer)["influenced vs first-touch pipeline"]
    assert not checks(t, attribution=fewer)["influenced vs first-touch won"]
    channels = _channels(t)
    wrong = channels.withColumns({c: F.col(c) + 1 for c in ("total_pipeline", "won_pipeline", "won_count")})
    got = checks(t, channels=wrong)
    named = ("channel pipeline", "channel won revenue", "channel won count", "report won revenue", "report won count")
    assert [k for k, ok in got.items() if not ok and k.startswith(named)] and sum(not ok for ok in got.values()) == 5
