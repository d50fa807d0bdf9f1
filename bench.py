"""Benchmark: time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores, BENCH_QUERIES (optional)
a comma-separated choice of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

from grainsift.queries import QUERIES
from grainsift.session import local_session

HEADLINE = [
    "profile_table", "profile_numeric", "missing_report", "duplicate_report", "outliers_iqr",
    "fill_median", "fill_mode", "fill_forward", "fill_forward_per_user",
    "dedup_full", "dedup_first", "dedup_none",
    "cast_float", "cast_datetime", "std_title", "regex_replace_text",
    "row_ordinal", "sort_nulls_last",
    "rules_report", "rules_quarantine_bad",
    "inject_logic_errors", "scenario_dirty",
    "score_accuracy_keyed", "score_accuracy_positional", "score_golden", "score_composite",
    "recipe_run", "lineage_log", "stream_rules_by_window",
    "near_duplicate_pairs", "snap_to_dictionary", "profile_state_merged", "distinct_keys_merged", "profile_topk_events",
    "row_ordinal_source", "fill_forward_source", "sql_clean",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    QUERIES["rules_report"].build(spark, folder).collect()  # starts the JVM's compilers
    for name in names:
        runs = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            # the no-op sink computes every row and column without keeping them
            QUERIES[name].build(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        times[name] = round(min(runs), 3)
        print(f"{name}: {times[name]} s (first run {runs[0]:.2f} s)", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
