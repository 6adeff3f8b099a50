"""A hot key must be cut by adaptive execution, not left to one task."""

import pytest
from pyspark.sql import functions as F

from dealtrace.operators import lookup_join

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, rows=400_000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 500))
    return spark.range(0, rows, 1, 8).select("id", key.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def test_hot_key_is_split(tight):
    left = hot(tight)
    right = left.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    joined = lookup_join(left, right, "key", spread="id")
    got = joined.agg(F.count("*"), F.count("n"), F.max("n")).first()
    want = left.count(), left.where("key IS NOT NULL").count(), left.where("key = 'hot'").count()
    assert tuple(got) == want
    joined.write.format("noop").mode("overwrite").save()
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan.split("== Initial Plan ==")[0]


def test_inner_lookup_drops_rows_without_key(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "key string, v int")
    right = spark.createDataFrame([("a", "x"), (None, "y")], "key string, w string")
    assert [tuple(r) for r in lookup_join(left, right, "key", "inner").collect()] == [("a", 1, "x")]
    kept = {r.v: r.w for r in lookup_join(left, right, "key", spread="v").collect()}
    assert kept == {1: "x", 2: None, 3: None}
    with pytest.raises(ValueError):
        lookup_join(left, right, "key", "full")
