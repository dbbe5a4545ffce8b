"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder with the Parquet tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local executor threads           (default 8)
    BENCH_RUNS    timed runs per query             (default 3, median taken)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

import registry

HEADLINE = (
    "q_district_report",
    "q_student_errors",
    "q_all_students",
    "q_capacity_sheet",
    "q_school_report",
    "q_room_base",
    "q_enrollment",
    "q_history_report",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("roomledger-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="roomledger-bench-"))
        # A second of bookkeeping per query otherwise: Python call sites of every expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    timed = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        timed[name] = round(
            statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3
        )
        print(name, timed[name], file=sys.stderr)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "headline queries, sum of median wall seconds",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
