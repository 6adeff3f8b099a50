"""The filter between documents and benchmark: it loses nothing, and what is sent to executors does not grow with the benchmark."""

import random

from pyspark.sql import functions as F

from dealtrace.llm import decontaminate as D


def frame(spark, rows, key):
    return spark.createDataFrame([(i, " ".join(x)) for i, x in rows], f"{key} long, text string")


def corpus(n, seed=3):
    """Documents and items of random words; document k holds item k in its middle."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5_000)}"
    items = [(k, [word() for _ in range(rng.randrange(4, 40))]) for k in range(n)]
    docs = [(k, [word() for _ in range(20)] + item + [word() for _ in range(20)]) for k, item in items]
    return docs, items


def sent(df):
    """Joins whose side is sent to all executors whatever its size."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")


def test_a_larger_benchmark_sends_no_more_to_the_executors(spark):
    docs, items = corpus(120)
    docs, items = frame(spark, docs, "doc_id"), frame(spark, items, "item_id")
    few, many = D.leaks(docs, items.limit(3)), D.leaks(docs, items, block_seeds=100)
    assert sent(many) == sent(few) > 0
    assert {(r.doc_id, r.item_id) for r in many.collect()} == {(k, k) for k in range(120)}


def test_a_filter_too_small_for_its_seeds_loses_nothing(spark):
    docs, items = corpus(60)
    docs, items = frame(spark, docs, "doc_id"), frame(spark, items, "item_id")
    rows = [sorted(map(tuple, D.leaks(docs, items, block_seeds=n).collect())) for n in (1, 1_000, D.BLOCK_SEEDS)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 60


def test_the_filter_parts_the_rows(spark):
    numbers = spark.range(3_000).select(F.xxhash64("id").alias("x"))
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("no"))
    rows = rows.unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS no"))
    inside = {r.id for r in D._among(rows, "no", numbers, 3_000, D.BLOCK_SEEDS).collect()}
    outside = {r.id for r in D._among(rows, "no", numbers, 3_000, D.BLOCK_SEEDS, "left_anti").collect()}
    assert set(range(3_000)) <= inside and len(inside) < 3_300
    assert not inside & outside and inside | outside == {-1, *range(20_000)}


def test_items_of_one_text_or_of_one_id(spark):
    words = [f"u{i}" for i in range(20)]
    items = [(1, words), (2, words), (3, words[:10]), (3, words[5:]), (None, words)]
    found = D.leaks(frame(spark, [(7, ["x", *words]), (7, words), (None, words)], "doc_id"), frame(spark, items, "item_id"))
    got = {(r.doc_id, r.item_id): (r.at_word, r.n_words, r.matched) for r in found.collect()}
    assert got == {(d, k): (a, n, n) for d in (7, None) for k, a, n in ((1, 0, 20), (2, 0, 20), (None, 0, 20), (3, 5, 15))}


def test_documents_keep_their_rows_whatever_the_filter(spark):
    docs, items = corpus(40)
    rows = [*docs, *docs[:5], (None, docs[0][1]), (None, ["alone"]), (50, [])]
    df = frame(spark, rows, "doc_id").withColumn("n", F.lit(1))
    items = frame(spark, items[:30], "item_id")
    for size in (1, D.BLOCK_SEEDS):
        kept = D.without_leaks(df, items, block_seeds=size)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(k) for k in range(30, 40)), "50", "None"])


def test_only_texts_that_the_filter_leaves_are_shuffled(spark):
    docs, items = corpus(40)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = D.without_leaks(frame(spark, docs, "doc_id"), frame(spark, items[:30], "item_id"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftAnti, BuildRight" in plan
        assert sorted(r.doc_id for r in kept.collect()) == list(range(30, 40))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
