"""Registered queries: against their SQL twins, and the shape of their plans."""

import math
import re

import duckdb
import pytest

from dealtrace.catalog import bindings as B
from dealtrace.catalog.oracles import ORACLES, with_store
from dealtrace.catalog.queries import QUERIES
from dealtrace.operators import sweep
from dealtrace.sources.scratch import shared_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in B.GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(with_store(shared_folder(spark))[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(comparable(r[i]) for i in order) for r in cursor.fetchall())
    got = sorted(tuple(comparable(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|Arrow", plan)


def test_filters_and_columns_reach_the_files(spark):
    plan = QUERIES["monthly_campaign"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<ts:timestamp,event_type:string,value:double>" in plan


def test_touch_links_write_the_log_once_and_read_even_ranges(spark, monkeypatch):
    kept, ranges = [], []
    write, lay_out = sweep.keep, sweep.in_ranges
    monkeypatch.setattr(sweep, "RANGE_ROWS", 1_000)
    monkeypatch.setattr(sweep, "keep", lambda df, label: kept.append(label) or write(df, label))
    monkeypatch.setattr(sweep, "in_ranges", lambda *a, **k: ranges.append(lay_out(*a, **k)) or ranges[-1])
    df = QUERIES["deal_channel_links"](spark, FOLDER)
    df.collect()
    assert kept.count("touch-log") == 1 and len(ranges) == 1
    sizes = [r["count"] for r in ranges[0].groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * 1_000
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    assert len(scans) == 2 and all("touch-ranges" in line for line in scans)
