"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the sample tables (default /root/testdata/sf0.1)
BENCH_CPUS:   local threads (default 8)
BENCH_RUNS:   runs per query, of which the median counts (default 3)
BENCH_ALL:    set to time every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from chronaudit import bindings  # noqa: E402

HEADLINE = [
    "c01_missing_dates", "c02_missing_month_ends", "c03_missing_dates_any", "c06_null_id_dates",
    "c07_orphan_ids", "c08_orphan_rows", "c09_group_growth", "c11_missing_flag_after_event",
    "c12_unmatched_events", "c13_irregular_gaps", "c14_row_mismatch", "c15_issue_summary",
    "c20_day_status", "c22_status_codes", "c27_join_by_date", "c31_stale_weekly", "c33_run_checks",
    "c33b_run_checks_by_table", "j05_in_subquery", "w03_drop_latest", "w04_neighbours", "u04_union_distinct",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronaudit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="chronaudit-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(query, spark, folder) -> float:
    """Seconds to plan the query and compute all of its rows."""
    began = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registered = bindings.queries()
    names = list(registered) if os.environ.get("BENCH_ALL") else HEADLINE
    run(registered["c33_run_checks"], spark, folder)  # start-up is not the query's time
    timings = {}
    for name in names:
        timings[name] = round(
            statistics.median(run(registered[name], spark, folder) for _ in range(runs)), 3
        )
        print(name, timings[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
