"""Benchmark: seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyfold.plans.queries import QUERIES  # noqa: E402
from tallyfold.session import drop_scratch, local_session  # noqa: E402

HEADLINE = [
    "s1_parquet_scan",
    "a1_class_counts",
    "a7_a8_auc_and_ap_distinct_scores",
    "a7_a8_auc_and_ap_tied_scores",
    "a9_histogram",
    "a11_metric_curve",
    "a12_dictionary_growth",
    "w1_global_ordinal",
    "w2_running_class_counts",
    "w3_shuffle_rank",
    "w4_sample_per_group_and_class",
    "k1_sample_exact_n",
    "k2_stratified_sample",
    "c2_train_val_split",
    "c3_positive_top_up",
    "c4_learner_allotment",
    "j2_rows_in_set",
    "f3_token_chain_fingerprint",
    "f3_token_chain_fingerprint_fast_hash",
    "f4_pattern_key_fingerprint",
    "f6_graph_fingerprint_tables",
    "f6_graph_fingerprint_rows",
    "f7_x4_category_code_appended",
    "l3_early_stopping",
    "l7_s13_validation_metrics",
    "l1_l2_l4_model_scores",
    "l5_f8_stacked_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["s2_row_count"](spark, sf_dir).collect()  # start the JVM before the clock runs
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # every row is produced in full and thrown away
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
