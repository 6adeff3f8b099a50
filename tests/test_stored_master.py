"""Bucketed stage tables: the account table from them, its plan, and what a new month rewrites."""

import re

import pytest
from pyspark.sql import functions as F

from dealtrace.catalog.queries import Tables
from dealtrace.functions import scalars as S
from dealtrace.plans.account360 import account360, domain_facts
from dealtrace.plans.stored_master import MasterStore, facts_of, monthly_facts

FOLDER = "/root/testdata/sf0.001"
TIMES = {"segments": "activity_date", "campaign": "activity_date", "email": "event_time", "web": "event_time"}


def rows(df):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def events(t, keep=None):
    frames = [getattr(t, name) for name in TIMES]
    return frames if keep is None else [df.where(keep(S.month(TIMES[n]))) for n, df in zip(TIMES, frames)]


def test_months_merge_to_the_facts_of_all_events(t):
    assert rows(facts_of(monthly_facts(*events(t)))) == rows(domain_facts(*events(t)))


def test_stored_account_table_equals_the_computed_one_without_a_shuffle(spark, t, tmp_path):
    store = MasterStore(str(tmp_path), buckets=8)
    months = store.write_months(*events(t))
    store.write_accounts(t.accounts, t.opps, t.contacts, months)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = store.read(spark)
        joined = got._jdf.queryExecution().executedPlan().toString()
        merged = facts_of(months.read(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in joined and not re.search("Exchange", joined)
    assert "Aggregate" in merged and not re.search("Exchange", merged)
    want = account360(t.accounts, t.segments, t.campaign, t.email, t.web, t.opps, t.contacts)
    assert rows(got) == rows(want)


def test_a_new_month_rewrites_only_its_own_files(spark, t, tmp_path):
    store = MasterStore(str(tmp_path), buckets=4)
    months = store.write_months(*events(t))
    files = lambda: {f for f in months.read(spark).inputFiles()}
    before = files()
    month = months.read(spark).agg(F.min("month")).first()[0]
    store.write_months(*events(t, lambda m: m == month))
    after = files()
    assert rows(facts_of(months.read(spark))) == rows(domain_facts(*events(t)))
    assert {f for f in before if f"month={month}" not in f} == {f for f in after if f"month={month}" not in f}
    assert not {f for f in before if f"month={month}" in f} & after
    whole = [a.where(~F.coalesce(S.month(TIMES[n]) == month, F.lit(False))) for n, a in zip(TIMES, events(t))]
    months.drop(spark, month)
    assert rows(facts_of(months.read(spark))) == rows(domain_facts(*whole))


def test_rows_without_date_or_domain_and_empty_tables(spark, t, tmp_path):
    undated = [df.withColumn(TIMES[n], F.lit(None).cast(df.schema[TIMES[n]].dataType)) for n, df in zip(TIMES, events(t))]
    store = MasterStore(str(tmp_path / "undated"), buckets=4)
    months = store.write_months(*undated)
    assert [r[0] for r in months.read(spark).select("month").distinct().collect()] == ["undated"]
    assert rows(facts_of(months.read(spark))) == rows(domain_facts(*undated))
    empty = MasterStore(str(tmp_path / "empty"), buckets=4)
    months = empty.write_months(*(df.limit(0) for df in events(t)))
    empty.write_accounts(t.accounts.limit(0), t.opps.limit(0), t.contacts.limit(0), months)
    assert empty.read(spark).count() == 0


def test_another_session_reads_the_folder(spark, t, tmp_path):
    store = MasterStore(str(tmp_path), buckets=4)
    store.write_accounts(t.accounts, t.opps, t.contacts, store.write_months(*events(t)))
    want = store.read(spark).count()
    other = spark.newSession()
    for name in [r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("bucketed_")]:
        other.sql(f"DROP TABLE IF EXISTS {name}")
    assert store.read(other).count() == want
