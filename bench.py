"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline set), BENCH_MEMORY (default 16g).
Every query is run once to warm up, then timed; the whole result is produced.
"""

from __future__ import annotations

import json
import os
import time

from checks import queries
from pricewake.session import local_session

HEADLINE = [
    "clean_observations",
    "search_products",
    "daily_prices",
    "catalogue",
    "market_movers",
    "top_drops",
    "price_stats",
    "trim_outliers",
    "tablet_features",
    "mobile_features",
    "tablet_training_set",
    "mobile_training_set",
    "ols_moments",
    "fit_tablet",
    "fit_mobile",
    "recursive_forecast",
    "recursive_forecast_fixed",
    "next_price",
    "product_summary",
    "chart_series",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, int(cpus), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        for timed in (False, True):
            spark.catalog.clearCache()
            start = time.perf_counter()
            queries.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
