"""Time the registered queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads, BENCH_QUERIES (comma list) a subset.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from groundwire.plans.catalog import QUERIES  # noqa: E402
from groundwire.plans.session import local_session  # noqa: E402

HEADLINE = (
    "read_requests", "route_modality", "classify_complexity", "classify_documents", "decide_tier",
    "build_inference_batch", "tier_share", "object_events", "chunk_documents", "corpus_stats",
    "upsert_chunks", "vector_topk", "vector_topk_blocked", "vector_topk_ann", "retrieve_knowledge",
    "pair_turns", "pair_tool_results", "citation_grounding", "tool_loop", "finalize_responses",
    "metric_rollup", "anonymize_documents", "apply_policy", "pii_findings", "vision_label_counts",
    "dashboard_rollup", "latency_p99", "alarm_state_errors", "quota_usage", "retention_report",
    "stream_ingest", "stream_alarm_edges_errors",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
