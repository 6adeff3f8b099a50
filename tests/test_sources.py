import json

import pytest
from pyspark.errors import AnalysisException

from dealtrace.sources import (
    TABLES,
    read_raw,
    read_report,
    read_table,
    read_table_or_empty,
    rows_as_json,
    write_json,
    write_report,
    write_table,
)


def test_raw_csv_is_text_with_trimmed_headers(spark, tmp_path):
    (tmp_path / "web.csv").write_text(" _domain, _utmsource\na.com,001\n")
    df = read_raw(spark, str(tmp_path), "web")
    assert df.dtypes == [("_domain", "string"), ("_utmsource", "string")]
    assert df.first()._utmsource == "001"


def test_raw_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "email.csv").write_text('_domain,_campaign_subject\na.com,"two\nlines"\n')
    df = read_raw(spark, str(tmp_path), "email", multi_line=True)
    assert df.first()._campaign_subject == "two\nlines"


def test_raw_parquet_becomes_text(spark, tmp_path):
    spark.createDataFrame([(1, 2.5)], "` a` int, b double").write.parquet(str(tmp_path / "ads.parquet"))
    df = read_raw(spark, str(tmp_path), "ads", {"ads": "ads.parquet"})
    assert df.dtypes == [("a", "string"), ("b", "string")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "i int, s string")
    write_table(df, str(tmp_path), "t")
    write_table(df, str(tmp_path), "t")
    assert read_table(spark, str(tmp_path), "t").collect() == df.collect()


def test_event_log_is_partitioned_by_month(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-02-03' AS at, 1 AS v UNION ALL SELECT timestamp'2024-03-03', 2")
    path = write_table(df, str(tmp_path), "log", month_of="at")
    got = spark.read.parquet(path).where("month = '2024-03'")
    assert [r.v for r in got.collect()] == [2]
    assert "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().executedPlan().toString()


def test_missing_table(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path), "web")
    empty = read_table_or_empty(spark, str(tmp_path), "web")
    assert empty.count() == 0 and empty.schema == TABLES["web"].schema()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "i int")
    write_report({"one": df, "two": df}, str(tmp_path), "r")
    assert read_report(spark, str(tmp_path), "r", "two").count() == 1


def test_json_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5)], "k string, n int, v double")
    assert json.loads(rows_as_json(df).first().row_json) == {"k": "a", "n": None, "v": 1.5}
    path = write_json(df, str(tmp_path / "j"))
    assert spark.read.json(path).count() == 1


def test_json_numbers_have_no_exponent(spark):
    values = [19233409.47, 11031942.0, 0.0, 0.0005, -12345678.5, 1.5, 737845718492.22, 0.1 + 0.2, None]
    rows = rows_as_json(spark.createDataFrame([("a", v) for v in values], "`k 1` string, v double")).collect()
    assert [r.row_json for r in rows] == [f'{{"k 1":"a","v":{"null" if v is None else repr(v)}}}' for v in values]
    odd = rows_as_json(spark.createDataFrame([("a,b", 1e300, None)], "k string, v double, m map<string,int>")).first()
    assert json.loads(odd.row_json) == {"k": "a,b", "v": 1e300, "m": None}
