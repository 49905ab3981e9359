"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated
choice ("all" for every registered query). Results go to Spark's no-op sink, so every
column of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from duecast.plans.catalog import all_queries
from duecast.session import build

HEADLINE = [
    "risk_by_segment", "history_training_features", "history_serving_features", "history_simple", "scalar_credit_behaviour",
    "scalar_money_fields", "ingest_loan_layout", "filter_demand_problems", "filter_search_all", "measure_classification",
    "measure_regression", "measure_threshold_sweep", "measure_quantiles", "quality_credit_rules", "quality_row_diagnostics",
    "combine_adapted_rollup", "combine_fingerprints", "join_assessments", "demand_short_features", "demand_long_features",
    "demand_cash_assessment", "split_position", "split_classes", "forecast_projection", "forecast_flags", "forecast_alerts",
    "profile_columns", "clean_rows", "score_drivers", "score_payments", "score_company_policy", "models_active",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build("duecast-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    if spark.conf.get("spark.checkpoint.dir", None) is None:  # one machine: its own folder is shared
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="duecast-bench-"))
    spark.sparkContext.setLogLevel("OFF")
    # The first query pays for starting the JVM's code paths; that is not part of any query.
    queries[names[0]](spark, root).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    report = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/"))}
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
