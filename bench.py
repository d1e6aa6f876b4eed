"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pairloom.plans.all_queries import QUERIES
from pairloom.session import local_session

HEADLINE = [
    "d03_turn_pairs", "d07_dedup", "d07_dedup_documents", "d09_split", "d14_catalog_listing", "d20_end_to_end_prepare",
    "e01_exact_match", "e04_bag_comparison", "e07_failure_category", "e08_clause_features", "e09_accuracy",
    "e10_latency_percentiles", "e14_run_row", "e18_unigram_bleu",
    "p03_floor_percentiles", "p04_validity_report",
    "q04_top_customers", "q05_bridge_join", "q07_having_alias", "q08_last_30_days", "q10_three_way_join", "q19_foreign_keys",
    "r06_previous_checkpoint", "r09_replay_log", "r14_active_at",
    "s08_unknown_tables", "s09_unknown_columns", "s13_verdict", "s14_validation_row", "s16_prompt_injection",
    "t05_load_metrics", "t09_smoothed_loss", "t13_sliding_rate", "t16_streaming_counters", "t17_streaming_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code generation and the Python workers outside the timings.
    QUERIES["q04_top_customers"](spark, folder).collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
