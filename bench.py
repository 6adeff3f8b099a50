"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
all), BENCH_RUNS (timed runs per query after one warm-up; the best is kept),
BENCH_QUERIES (comma-separated names instead of the headline ones).

``once`` is the first win_probability, which fits the model that later queries
load; ``widest_rows`` counts the rows of the touch sweep's widest step at its
default window.
"""

from __future__ import annotations

import json
import os
import time

from dealtrace.catalog.queries import QUERIES
from dealtrace.operators import sweep
from dealtrace.session import local_session

HEADLINE = [
    "latest_state_merge",
    "clean_opportunities",
    "clean_ads",
    "clean_email",
    "account360",
    "channel_pipeline",
    "funnel_metrics",
    "creative_performance",
    "creative_by_attribute",
    "email_by_campaign",
    "touchpoints",
    "linked_touches",
    "deal_channel_links",
    "deal_channel_links_default",
    "attr_time_decay",
    "attr_all_models",
    "attr_all_models_default",
    "journeys",
    "coverage_summary",
    "velocity_channel",
    "targeting_matrix",
    "cohort_quarterly",
    "kpis",
    "reconciliation",
]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def widest_rows(spark, folder: str) -> int:
    made, seen = sweep.in_ranges, []
    sweep.in_ranges = lambda *a, **k: seen.append(made(*a, **k)) or seen[-1]
    try:
        QUERIES["deal_channel_links_default"](spark, folder)
    finally:
        sweep.in_ranges = made
    return max(df.count() for df in seen)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus, partitions=int(cpus))
    timed = {}
    for name in names:
        warm = seconds(spark, name, folder)
        timed[name] = round(min([seconds(spark, name, folder) for _ in range(runs)] or [warm]), 3)
    extra = {}
    if names is HEADLINE:
        extra["once"] = {"win_probability": round(seconds(spark, "win_probability", folder), 3)}
        extra["widest_rows"] = widest_rows(spark, folder)
    spark.stop()
    result = {
        "metric": "total_seconds",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": os.path.basename(folder.rstrip("/")),
        **extra,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
