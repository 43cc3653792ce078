"""Times the headline queries: one run as it comes, then the median of three more. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = ["q_vector", "q_knn_all_pairs", "q_lexical", "q_hybrid", "q_suggest", "cdc_diff", "agg_tree_count", "agg_peak_rms", "agg_pyramid", "q_echo_coarse", "q_echo_fine", "agg_collapse_dups"]
REPEATS = 3


def main() -> None:
    from lodestrum.plans import registry
    from lodestrum.session import session

    registry.load()
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "sum of the warm medians of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
