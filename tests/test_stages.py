"""Raw files to checked reports, with the raw column names."""

from dealtrace.catalog import bindings as B
from dealtrace.plans import stages
from dealtrace.sources import TABLES, read_report, read_table

FOLDER = "/root/testdata/sf0.001"


def test_whole_run(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    for name in TABLES:
        frame = B.bound(spark, FOLDER, f"raw_{name}")
        frame.write.parquet(f"{raw}/{name}")
    checks = {r.check: r.ok for r in stages.run_all(spark, raw, out, {n: n for n in TABLES}, trees=5).collect()}
    assert len(checks) == 18
    # Deals of accounts missing from the account table are appended to it, so all add up.
    assert all(checks.values()), checks
    results = read_table(spark, f"{out}/integrated", "attribution_results")
    assert results.where("attribution_model = 'Marketing Sourced'").count() > 0
    assert read_report(spark, f"{out}/reports", "budget", "scenarios").columns[0] == "scenario_no"
    assert read_table(spark, f"{out}/integrated", "win_probability").count() > 0
    assert "month" in read_table(spark, f"{out}/integrated", "touchpoints").columns
