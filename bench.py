"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query is
built and written to Spark's no-op sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from basketcast.catalog import QUERIES
from basketcast.session import local_session

HEADLINE = (
    "attach_targets", "filter_returns", "exclude_return_sessions", "temporal_split", "calendar_parts", "holiday_or_weekend",
    "log_with_product", "map_category", "session_category_amount", "session_category_quantity", "customer_category_matrix",
    "purchase_ratio", "recency_global", "recency_asof", "purchase_gaps", "bayes_counts", "group_mean", "conditional_purchase",
    "session_money", "customer_money", "purchase_sequence", "sequence_patterns", "latest_sequence", "customer_sessions",
    "sliding_windows", "valid_history", "test_history", "stratified_group_folds", "target_encode_oof", "bayes_posterior",
    "lookup_marginals", "bayes_score", "error_correction", "confidence_grid", "threshold_sweep", "macro_auc",
    "prediction_summary", "quantile_bin10", "assemble_features", "truncated_svd", "nmf",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # Start-up of the engine and the first code generation are not measured.
    QUERIES["attach_targets"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
