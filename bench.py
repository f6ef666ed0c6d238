"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the
timed runs per query (after one warm-up; the median counts). ``shuffles`` counts the
exchanges in the final plan, without those of steps written before.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from querydelta.registry import load  # noqa: E402
from querydelta.session import local_session  # noqa: E402

HEADLINE = """
bag_diff result_summary ordered_diff repair_check duplicate_rows table_digest
truth_profile divergence_counts boolean_truth_table boundary_tristate in_list_paths like_separation null_safe_paths
case_coverage join_path_profile join_condition_divergence join_type_effect outer_predicate_placement fanout_inflation
self_join_range membership_paths null_antijoin_divergence scalar_subquery_cardinality correlated_aggregate_boundary
group_grain_diff aggregate_boundary joined_aggregate_boundary aggregate_function_separation count_distinct_sensitivity
filter_placement distinct_effect nested_distinct_effect set_op_effect window_path_profile rank_function_divergence
frame_divergence lag_lead_paths window_filter_boundary order_separation topn_membership_diff topn_cutoff_ties
hierarchy_paths check_constraints seed_table witness_sample repair_duplicate_keys logical_stage evidence_grade
classify_rule build_candidates corpus_leaks dedupe_cases replay_agreement suite_report
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench")
    registry = load()
    seconds, shuffles = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            result = registry[name].run(spark, folder)
            result.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        plan = result._jdf.queryExecution().executedPlan().toString()
        shuffles[name] = plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        print(f"{seconds[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "shuffles": shuffles, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
