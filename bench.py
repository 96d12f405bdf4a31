"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "triage_action_counts", "guardrail_rows", "model_features", "ranking_quality", "threshold_sweep",
    "configuration_study", "pareto_front", "stratified_holdout", "evaluation_runs", "psi_drift", "ks_drift",
    "group_metrics", "consensus_live", "citation_contexts", "keyword_overlap",
]


def main() -> None:
    from pairsieve.plans.catalogue import ENTRIES
    from pairsieve.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    ENTRIES["guardrail_rows"].run(spark, folder).limit(1).collect()  # the session's first query pays for its start
    times, errors = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the other timings stay worth having
            errors[name] = str(error).strip().splitlines()[0][:200]
            continue
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"), **({"errors": errors} if errors else {}),
    }))
    if errors:
        sys.exit(1)


if __name__ == "__main__":
    main()
