"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugesieve.plans import catalog  # noqa: E402

HEADLINE = (
    "q_quality_flags", "q_quality_summary", "q_duplicate_flags", "q_percentiles", "q_numeric_stats",
    "q_outlier_candidates", "q_class_stats", "q_associations", "q_pattern_lift", "q_relationships",
    "q_sensor_aggs", "q_residuals", "q_iqr", "q_zscore", "q_detector_metrics", "q_roc_auc",
    "q_threshold_sweep", "q_fold_stability", "q_hybrid_comparison", "q_iforest", "q_random_forest",
    "q_diagnostics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gaugesieve-bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = os.environ.get("BENCH_QUERIES")
    seconds = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
