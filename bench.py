"""Headline timings: runs the main jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect to the
driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e2_language_confidence",
    "f2_score_completions",
    "g1_accuracy_boxed",
    "g6_best_of_n",
    "g8_majority_winner",
    "g9_majority_metrics",
    "g12_pivot_metrics",
    "h8_issue_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from glossa.plans.catalog import QUERIES
    from glossa.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2, app="glossa-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if n in QUERIES]
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
