"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores. Each
query is planned and run in full, results going to a sink that discards them;
the first run warms the session up and the better of two timed runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termwise.checks.queries import QUERIES  # noqa: E402
from termwise.session import local_session  # noqa: E402

HEADLINE = (
    "qc_checks",
    "stg_student_enrollment",
    "int_program_episodes",
    "fct_enrollment_term",
    "fct_graduation_rate",
    "fct_retention_rate_cohort",
    "fct_graduation_rate_term",
    "fct_retention_rate_term",
    "graduation_term_eligible",
    "headcount_by_term",
    "m_pell_enrollment_rate",
    "ask_eng_retention",
    "risk_join_enrollment",
    "leak_scan",
    "route_questions",
    "recent_transcript",
    "chunk_documents",
    "retrieve_topk",
    "profile_columns",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)), "termwise-bench")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
