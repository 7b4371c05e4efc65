"""Time the headline queries; prints one JSON line.

Each query runs once to warm the JVM and once timed, into the no-op sink, so that planning
and execution of the whole result are measured but no rows travel to the driver.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cashtide.plans import catalog  # noqa: E402
from cashtide.session import local_session  # noqa: E402

HEADLINE = [
    "normalize_payload",
    "p2p_split",
    "dedup_first_wins",
    "dedup_duplicates_report",
    "topk_per_account",
    "account_balances",
    "balance_daily_snapshots",
    "kpi_monthly_by_account",
    "company_stats",
    "latency_p95",
    "daily_rollup",
    "daily_channel",
    "daily_features",
    "forward_targets_strict",
    "training_set",
    "daily_merge_additive",
    "kpi_upsert",
    "split_best",
    "m5p_train_all_targets",
    "m5p_unaltered",
    "m5p_deep_nodes",
    "m5p_predict_all",
    "stream_daily_rollup",
]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, cores, spark__ui__showConsoleProgress="false")
    queries = catalog.queries()
    times = {}
    for name in HEADLINE:
        run(queries[name](spark, sf_dir))
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
