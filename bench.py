"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS (default 8)
sets the local cores. Every query runs once unmeasured on the same data to start
workers and compile, then BENCH_REPEATS (default 1) times; the fastest counts.
Results are written to a sink that keeps nothing, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from storygraph.plans.catalogue import REGISTRY
from storygraph.session import build_session, scratch

QUERIES = [
    "assign_nearest",
    "assign_nearest_blocks",
    "similar_pairs",
    "dbscan_labels",
    "dbscan_core_border",
    "embed_documents",
    "enrich_articles",
    "cluster_embedding",
    "updated_cluster_embedding",
    "cluster_run",
    "cluster_run_changes",
    "extract_listing",
    "extract_blocks",
    "ingest_run",
    "ledger_sets",
    "daily_url_dedup",
    "listing_quota",
    "unseen_urls",
    "feed_stats",
    "parse_date_named_month",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session("storygraph-bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in QUERIES:
        runs = []
        for _ in range(repeats + 1):
            with scratch(spark):
                start = time.perf_counter()
                REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, warm",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
