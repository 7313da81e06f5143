"""Time the headline queries; prints one JSON line.

Each query is written to the no-op sink, which computes every row and column. The value per
query is the median of ``BENCH_REPEATS`` runs after one warm-up; a query that takes longer
than ``BENCH_LONG`` seconds is run once after its warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parity import QUERIES  # noqa: E402

HEADLINES = (
    "features",
    "labeled_features",
    "add_target",
    "asof_between_tables_backward",
    "asof_between_tables_forward",
    "trailing_statistics",
    "change_log_collapse",
    "newest_station_rows",
    "keep_last_replay",
    "quality_filter",
    "time_split",
    "persistence_metrics",
    "station_codes",
    "vehicle_split",
    "propulsion_counts",
    "salted_lookup",
    "window_merge",
    "days_needing_export",
    "rows_after_retention",
    "cycle_violations",
    "flattened_status",
    "forecast_persistence",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    long = float(os.environ.get("BENCH_LONG", "10"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stationflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # building a plan should not be timed together with recording its source lines
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        times = [run(name)]
        while len(times) < repeats and times[-1] < long:
            times.append(run(name))
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
