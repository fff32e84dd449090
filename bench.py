"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query starts without stored views, so the time holds everything from the parquet files on.  One warm-up query
runs first and is not counted.  The queries run in three rounds; ``queries`` holds the medians, ``first`` the first round.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from crossrisk.plans import catalog, views  # noqa: E402

HEADLINE = ["screen_scores", "backtest_panel", "forward_maxdd", "asof_features", "momentum_asof", "per_entity_betas",
            "factor_panel", "rolling_beta", "sector_peer_delta", "spearman_ic", "roc", "knn5", "silhouette",
            "event_count_90d", "ttm"]

ROUNDS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("crossrisk-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crossrisk-bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["rebalance_calendar"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    rounds = {name: [] for name in names}
    for _ in range(ROUNDS):
        for name in names:
            views.forget_stored()
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            rounds[name].append(time.perf_counter() - start)
    spark.stop()
    took = {name: round(statistics.median(r), 3) for name, r in rounds.items()}
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "first": {name: round(r[0], 3) for name, r in rounds.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
