"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 2, the fastest counts: the first run of a JVM compiles its code).
Results are written to a sink that keeps nothing, so every row is computed and
none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from recallspark.session import local_session
from recallspark.suite import registry

HEADLINE = [
    "search_limit", "label_dict", "label_expression", "label_negation", "search_substring", "timeline_before",
    "tokenize_stats", "bm25_topk", "derived_edges", "duplicate_pairs", "walk_edges", "recall_blend",
    "pagerank_whole_graph", "usage_fold", "spread_days", "audit_verdicts", "rrf_fuse", "choose_remote",
    "outbox_classify", "secret_scan", "validate_messages", "merge_records",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    queries = registry.queries()
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
            spark.catalog.clearCache()
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
