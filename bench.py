"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "rollup_conditional_sum",
    "rollup_python_conditions",
    "rollup_text_conditions",
    "rollup_two_sheets",
    "rollup_backfill",
    "rollup_row_issues",
    "cell_numbers",
    "periods",
    "comparison_forms",
    "wrapped_values",
    "encoding_quality",
    "data_cells",
    "grid_rollup",
    "check_fields",
    "csv_scan",
    "merged_ranges",
    "reconcile_differences",
    "reconcile_summary",
    "upsert_actions",
    "upsert_stored_table",
    "check_targets",
    "session_summaries",
    "event_kind_counts",
    "artifact_grades",
    "batch_totals_by_suite",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from ledgerspark.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_median",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
