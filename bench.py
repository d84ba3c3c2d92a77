"""Times the headline queries and prints one JSON line. Set BENCH_SF_DIR and BENCH_CPUS to change the run."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from demand_engine.plans import catalog
from demand_engine.session import build_session

HEADLINE = [
    "f4_weekly_by_sku",
    "b3_exclude_balanced_guides",
    "c1_cap_p99",
    "c2_replace_iqr_outliers",
    "d1_sales_by_product",
    "e1_pareto_curve",
    "f5_weekly_demand",
    "g_all_features",
    "k2_classify_demand",
    "v1_correlation_matrix",
    "w3_ridge_grid",
    "x4_recursive_forecast",
    "y5_production_plan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first run warms up
            spark.catalog.clearCache()
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
