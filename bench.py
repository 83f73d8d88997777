"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores. Each query
runs twice and the better time counts, so JIT warm-up is left out.
"""

from __future__ import annotations

import json
import os
import sys
import time

from photofold.fixtures.registry import QUERIES
from photofold.session import local_session

HEADLINE = [
    "dup_edges",
    "dup_groups",
    "group_summary",
    "best_shot",
    "find_similar",
    "image_features",
    "categorize",
    "category_rollup",
    "sync_catalog",
    "upsert_coalesce",
    "review_fold",
    "review_batch",
    "failure_streak",
    "scan_batches",
    "group_members",
    "per_album_top_n",
    "stream_dup_groups",
    "scan",
    "stream_review",
    "stream_upsert",
    "stream_status",
    "keyset_page_clustered",
    "pending_images",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spent = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        spent[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, total",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores,
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
