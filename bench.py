"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from twinspan.catalog import registry
from twinspan.operators.store import release, staged
from twinspan.session import local_session

# Each is timed to the last row written to a sink that keeps nothing.
HEADLINES = (
    "fragments", "tokens_regex", "parameterize", "exact_copy_classes", "renamed_copy_classes",
    "copy_pair_totals", "copy_links", "candidate_pair_count", "near_miss_join", "bag_overlap_join",
    "cosine_pairs", "cosine_join", "evidence_join", "semantic_decide_embedding", "hash_features",
    "type_counts", "files_with_clones", "job_detail", "dashboard_stats", "latest_progress",
    "split_audit", "induced_pairs", "threshold_sweep", "confusion_metrics", "detect", "fit_pair_classifier",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Four shuffle partitions per core even out long rows; adaptive execution merges small ones.
    spark = local_session(cpus, 4 * int(cpus) if cpus.isdigit() else 32)
    queries = registry.build().queries
    # One unmeasured run starts the JVM's and the Python workers' engines.
    queries["copy_links"](spark, sf_dir.replace("sf0.1", "sf0.001")).count()
    seconds = {}
    for name in HEADLINES:
        before = staged()
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release(spark, [t for t in staged() if t not in before])
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "settings": {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")},
    }), flush=True)


if __name__ == "__main__":
    main()
