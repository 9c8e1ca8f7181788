"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from boutlens.plans.catalog import QUERIES
from boutlens.session import session

HEADLINE = [
    "division_rankings", "cumulative_before", "ewma_before", "streaks_before", "division_rate_asof", "auc_by_slice", "rematch_flags", "graph_edges",
    "pair_match", "asof_nearest_tolerance", "career_snapshot", "elo_overall",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus))
    QUERIES["fighter_record"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
