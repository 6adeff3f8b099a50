"""A state brought up to date in batches against one run over all of them."""

import os
import random

from dealtrace.operators import StateStore, latest_state

SCHEMA = "id string, version double, flag string, amount double, row_key long"


def log(n, seed, keys=60):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([None, *x])
    return [(rng.choice([f"k{rng.randrange(keys)}"] * 9 + [None]), pick(1.0, 2.0, 2.0, 3.0), pick("a", "b"), pick(1.5, 2.5), 1000 * seed + i) for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_in_any_order_equal_one_run(spark, tmp_path):
    parts = [log(200, s) for s in (1, 2, 3)]
    whole = spark.createDataFrame(sum(parts, []), SCHEMA)
    want = rows(latest_state(whole, ["id"], "version", ["row_key"]).select("id", "version", "flag", "amount"))
    for turn, order in enumerate(((0, 1, 2), (2, 0, 1))):
        store = StateStore(f"{tmp_path}/{turn}", ["id"], "version", ["row_key"], buckets=8)
        for i in order:
            store.apply(spark.createDataFrame(parts[i], SCHEMA))
        assert rows(store.read(spark).select("id", "version", "flag", "amount")) == want
        # The same batch again changes nothing.
        store.apply(spark.createDataFrame(parts[0], SCHEMA))
        assert rows(store.read(spark).select("id", "version", "flag", "amount")) == want


def test_only_the_buckets_with_changes_are_rewritten(spark, tmp_path):
    store = StateStore(str(tmp_path), ["id"], "version", ["row_key"], buckets=32)
    first = store.apply(spark.createDataFrame(log(400, 1, keys=300), SCHEMA))
    before = store.generations(spark)
    second = store.apply(spark.createDataFrame([("k5", 9.0, "z", None, 1), ("k5", 9.0, "z", None, 1)], SCHEMA))
    after = store.generations(spark)
    assert len(first) == 32 and len(second) == 1
    assert {b for b in after if after[b] != before.get(b)} == set(second)
    assert os.listdir(f"{tmp_path}/state/2") and {x for x in os.listdir(f"{tmp_path}/state/2") if "=" in x} == {f"_bucket={second[0]}"}
    row = {r.id: r for r in store.read(spark).collect()}["k5"]
    assert (row.version, row.flag) == (9.0, "z")


def test_an_unfinished_batch_leaves_the_state(spark, tmp_path):
    store = StateStore(str(tmp_path), ["id"], "version", ["row_key"], buckets=4)
    store.apply(spark.createDataFrame([("a", 1.0, "x", 1.0, 1)], SCHEMA))
    store.apply(spark.createDataFrame([("a", 2.0, "y", 2.0, 2)], SCHEMA))
    os.remove(f"{tmp_path}/lists/2/_SUCCESS")
    assert [r.flag for r in store.read(spark).collect()] == ["x"]
    # It is tried again under a number of its own.
    store.apply(spark.createDataFrame([("a", 2.0, "y", 2.0, 2)], SCHEMA))
    assert [r.flag for r in store.read(spark).collect()] == ["y"]


def test_odd_batches(spark, tmp_path):
    store = StateStore(str(tmp_path), ["id"], "version", buckets=4)
    assert store.apply(spark.createDataFrame([], SCHEMA)) == []
    assert store.apply(spark.createDataFrame([(None, 1.0, "x", 1.0, 1)], SCHEMA)) == []
    store.apply(spark.createDataFrame([("a", None, None, None, 1)] * 2 + [("a", 5.0, "q", None, 2)], SCHEMA))
    row = store.read(spark).first()
    assert (row.id, row.version, row.flag, row.amount, row.row_key) == ("a", 5.0, "q", None, 1)
