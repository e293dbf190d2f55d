"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

calibration is the time of a fixed job that has nothing to do with the queries: times from two machines compare after
division by it."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = ("kv_latest", "kv_get_keys", "kv_snapshot", "kv_asof_probe", "kv_delete_range", "kv_range_max_cover", "kv_merge_counter", "kv_merge_append", "kv_merge_range_delete", "kv_range_scan", "kv_batch_sequences", "cf_latest", "compact_full", "compact_merge_collapse", "txn_conflicts", "sst_properties")
RUNS = 3


def timed(f) -> float:
    """Median of the warm runs."""
    runs = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        f()
        runs.append(time.perf_counter() - start)
    return round(statistics.median(runs[1:]), 4)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidelog.queries import QUERIES

    run = lambda df: df.write.format("noop").mode("overwrite").save()
    calibration = timed(lambda: run(spark.range(4_000_000).selectExpr("id % 100003 k", "hash(id) v").groupBy("k").sum("v")))
    took = {name: timed(lambda: run(QUERIES[name](spark, sf))) for name in HEADLINE}
    print(json.dumps({"metric": "headline queries, sum of medians of three warm runs", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "calibration": calibration, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
