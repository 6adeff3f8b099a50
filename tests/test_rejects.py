"""Lines that do not fit and cells that do not parse."""

from dealtrace.sources import cell_counts, line_counts, read_checked
from dealtrace.sources.rejects import MALFORMED

COLUMNS = ["_6sensedomain", "_spend", "_date"]


def test_malformed_lines_are_kept_whole(spark, tmp_path):
    lines = ["_6sensedomain,_spend,_date", "a.com,1,2024-01-01", "b.com,2", "c.com,3,2024-01-02,x", ',4,"2024,1"', "d.com,,"]
    (tmp_path / "campaign.csv").write_text("\n".join(lines) + "\n")
    df = read_checked(spark, str(tmp_path), "campaign", COLUMNS)
    got = {r[MALFORMED]: (r._6sensedomain, r._spend) for r in df.collect()}
    assert got["b.com,2"] == ("b.com", "2") and got["c.com,3,2024-01-02,x"] == ("c.com", "3")
    assert len(df.where(f"{MALFORMED} IS NULL").collect()) == 3
    assert tuple(line_counts(df).first()) == (5, 2, 1)
    # Counting reads few columns, and still parses whole lines.
    assert [r._spend for r in df.where(f"{MALFORMED} IS NOT NULL").select("_spend").collect()] == ["2", "3"]


def test_an_empty_export(spark, tmp_path):
    (tmp_path / "campaign.csv").write_text("_6sensedomain,_spend,_date\n")
    df = read_checked(spark, str(tmp_path), "campaign", COLUMNS)
    assert tuple(line_counts(df).first()) == (0, 0, 0)
    assert [(r.column, r.rows, r.filled, r.rejected) for r in cell_counts(df.drop(MALFORMED), "campaign").collect()] == [
        ("spend", 0, 0, 0),
        ("activity_date", 0, 0, 0),
    ]


def test_rejected_cells_of_one_pass(spark):
    rows = [("1", "2024-01-01"), ("1,5", "soon"), ("null", ""), (None, "01/02/2024"), ("-", None), ("1e3", "2024-13-01")]
    df = spark.createDataFrame(rows, "_spend string, _date string")
    got = {r.column: (r.type, r.rows, r.filled, r.rejected) for r in cell_counts(df, "campaign").collect()}
    assert got == {"spend": ("double", 6, 3, 1), "activity_date": ("timestamp", 6, 4, 2)}
    plan = cell_counts(df, "campaign")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Scan ExistingRDD") == 1
