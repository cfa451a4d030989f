"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up, then three times; the median counts. Results go
to the noop sink, so all columns of all rows are computed and none is collected.
With ``--duckdb`` the SQL forms run in DuckDB on the same files instead.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "monitor_window_quality",
    "ks_by_window",
    "wasserstein_by_window",
    "drift_table",
    "quality_profile",
    "critical_windows",
    "rolling_article_stats",
    "customer_running_stats",
    "asof_customer",
    "week_bucket_aggs",
    "churn_features",
    "item_sales_features",
    "auc_exact",
    "threshold_sweep",
    "cohort_metrics",
    "ranking_metrics",
    "rf_regression",
]
HEAVY = {"week_bucket_aggs", "churn_features", "item_sales_features", "rf_regression"}


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def measure(run, repeats: int) -> float:
    return statistics.median(timed(run) for _ in range(repeats))


def spark_times(folder: str, cpus: int) -> dict[str, float]:
    from modelwake.catalog import QUERIES
    from modelwake.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:

        def run(name=name):
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

        run()
        times[name] = round(measure(run, 1 if name in HEAVY else 3), 3)
    spark.stop()
    return times


def duckdb_times(folder: str, cpus: int) -> dict[str, float]:
    import duckdb

    from oracle import ORACLE

    con = duckdb.connect()
    con.execute(f"SET threads = {cpus}")
    for file in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    times = {}
    for name in HEADLINE:
        if name in ORACLE:

            def run(name=name):
                con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {ORACLE[name]}")

            run()
            times[name] = round(measure(run, 1 if name in HEAVY else 3), 3)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    engine = "duckdb" if "--duckdb" in sys.argv else "spark"
    times = duckdb_times(folder, cpus) if engine == "duckdb" else spark_times(folder, cpus)
    print(
        json.dumps(
            {
                "metric": f"{engine}_headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
