"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Stage tables go to a new folder, so every run starts cold and each query pays for the stages
it is the first to need.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tickloom.functions.series import Layout  # noqa: E402
from tickloom.operators import indicators  # noqa: E402
from tickloom.plans import queries as registry  # noqa: E402

HEADLINES = (
    "bars_with_index", "label_shares", "rolling_price", "exponential_means", "recurrences_in_small_chunks", "validation_scores",
    "fold_results", "cross_fold_metrics", "benchmark_run_scores", "benchmark_summary", "run_log_flat", "correlation_matrix",
    "recommendations", "bars_by_brand",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.stage_root = tempfile.mkdtemp(prefix="tickloom-bench-")

    def brand_features(layout: Layout):
        return lambda s, d: indicators.engineer_features(registry.market(s, d, by_brand=True).bars(), layout)

    jobs = {name: registry.QUERIES[name] for name in HEADLINES}
    # 25 tickers: the whole feature table, one chunk per ticker and then several.
    jobs["brand_features"] = brand_features(Layout())
    jobs["brand_features_chunked"] = brand_features(Layout(1250))
    jobs["forecast_recommendations"] = registry.QUERIES["forecast_recommendations"]
    seconds = {}
    for name, job in jobs.items():
        start = time.time()
        job(spark, sf_dir).write.mode("overwrite").format("noop").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
