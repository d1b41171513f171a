"""Wall time of the headline queries, as one JSON line.

`BENCH_SF_DIR` is the table folder, `BENCH_CPUS` the local threads, `BENCH_RUNS`
the timed runs per query (their median counts), `BENCH_ALL=1` times every query.
Each run computes the whole result and discards it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tallybook.plans.workload import QUERIES

HEADLINE = """
dq_missing_all dq_exact_dedup dq_key_repeats dq_cardinality dq_ranges dq_score_distribution
derive_fields primary_dataset sensitivity_dataset kpi_summary kpi_compare
q1_period_score q2_category_score q3_category_high_share q4_period_coverage q5_segment_score
q6_period_category_rank q7_period_category_share q8b_tier_top_categories q9_dataset_compare
q10_period_profile ingest_standardise group_size_summary grouped_split random_split
model_eval sweep sweep_wide reduced_ols creator_buckets
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or (list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed query starts the session's code paths
    QUERIES["q1_period_score"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
