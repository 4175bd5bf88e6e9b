"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the number of
local cores (default all). Each query runs BENCH_RUNS times (default 2), the best counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from galewise.plans.registry import all_queries  # noqa: E402
from galewise.session import build_session  # noqa: E402

HEADLINES = [
    "knn_exact_filtered", "knn_exact_blocks", "knn_ivf_probe", "itemcf_candidates", "catalog_flags",
    "tower_join", "positives_per_context", "nce_loss", "bpr_step", "forecast_features",
    "wx_join_lag_issue", "station_labels", "calib_rmse", "weighted_logloss", "epoch_loss_report",
    "seed_sample", "split_counts", "ndcg", "lambda_gradients", "tree_score", "tree_inorder",
    "ranker_train", "calibration_train", "forest_classify", "rank_boost_train",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus != "*" else str(os.cpu_count()),
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["fn_dot"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": sf.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
