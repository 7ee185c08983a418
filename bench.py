"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR   input tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] cores (default 8)
    BENCH_RUNS     timed runs per query, median reported (default 3)

Every query is executed end to end with the ``noop`` sink (full plan, no
collect).  One untimed warm-up run of the cube precedes the timings.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from margincast import get_spark  # noqa: E402
from margincast.plans.catalog import REGISTRY  # noqa: E402

HEADLINE = {
    "weekly_cube": "a1_weekly_cube",
    "batch_features": "e2_batch_features",
    "service_features": "e3_service_features",
    "product_analysis": "a11_product_analysis",
    "kpis": "a8_kpis",
    "grid_search": "p5_grid_search",
    "optimization_report": "p8_optimization_report",
    "swarm_search": "p6_swarm_search",
    "dense_features": "e4_dense_features",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8))
    REGISTRY["a1_weekly_cube"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for label, name in HEADLINE.items():
        fn = REGISTRY[name][0]
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
            spark.catalog.clearCache()      # queries are independent: drop frames kept for reuse
        times[label] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
