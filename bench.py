"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of local cores.
Each query is built and run to the end, with its result discarded by Spark's no-op
sink; one untimed query warms the JVM up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gapweave.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "grid_complete",
    "ratio_fill_total",
    "ratio_fill_single",
    "linear_fill",
    "ltmean_fill",
    "ar1_filter",
    "ar1_filter_daily",
    "ar1_grid_fit",
    "ar1_mle_fit",
    "ar1_predict",
    "ar1_predict_total_se",
    "ar1_fill",
    "ar1_fill_estimated",
    "total_index",
    "index_fixed_cv",
    "reconcile_total",
    "method_score",
    "compare_external",
    "compare_methods",
    "grid_full_range",
    "linear_interpolate",
    "ratio_fill_daily",
    "linear_fill_daily",
    "linear_fill_supplier_days",
    "ar1_predict_daily",
    "segment_index",
    "ar1_filter_supplier_days",
    "ar1_filter_demeaned",
    "ar1_predict_demeaned",
    "ar1_predict_demeaned_daily",
    "compare_methods_estimated",
    "csv_inferred",
    "linear_fill_stored",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gapweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gapweave-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("segment_index")
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
