"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from cohortlab.session import get_session  # noqa: E402
from cohortlab.staging import clear_folders  # noqa: E402

HEADLINE = [
    "q_compound_cohort", "q_semi_join", "q_membership_flag", "q_coerce_numeric",
    "q_completeness_filtered", "q_value_counts", "q_value_proportions", "q_group_measures", "q_exact_quantiles",
    "q_cooccurrence", "q_prevalence", "q_numeric_summary", "q_describe", "q_binned_distribution", "q_histogram",
    "q_label_coverage", "q_stratified_sample", "q_stratified_split", "q_matched_negatives",
    "q_multi_seed_subsamples", "q_split_integrity", "q_crosstab", "q_cosine", "q_zero_shot_scores",
    "q_eval_report", "q_macro_average", "q_results_json_roundtrip", "q_fetch_manifest",
]


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, folder, "q_value_counts")  # start-up of the session is not a query's time
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(run(spark, folder, name), 3)
        if "-v" in sys.argv:
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    clear_folders(spark)
    spark.stop()


if __name__ == "__main__":
    main()
