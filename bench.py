"""Headline queries, timed: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) say
where and on how many cores. Each query is warmed once and run twice; its
result is consumed whole, and the faster run counts.
"""

from __future__ import annotations

import json
import os
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "hybrid_search bm25_search dense_search graded_eval hash_diff edit_events gap_sessions anchored_slices interval_overlaps failure_streak unanswered turn_merge "
    "nearest_rank_percentiles coverage_by_source usage_by_day task_dashboard superseded_facts personal_data_scan html_to_text blocked_jaccard"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quern.plans import QUERIES

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": FOLDER.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
