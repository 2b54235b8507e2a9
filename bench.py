"""Seconds per headline query on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quern.session import local_session
from quern.workload import QUERIES

HEADLINE = [
    "retrieve_prompt",
    "retrieve_text_topk",
    "retrieve_topk",
    "retrieve_cosine",
    "retrieve_ivf",
    "retrieve_lsh",
    "retrieve_two_contexts",
    "mmr_rerank",
    "mmr_kind_cap",
    "hash_embed",
    "normalize_text",
    "chunk_docs",
    "dedupe_kind",
    "sync_plan",
    "sync_apply",
    "item_upsert",
    "chunk_replace",
    "export_gapfill",
    "csv_kind_rows",
    "ragged_metadata",
    "audit_snapshot",
    "audit_full_text",
    "key_check_pk",
    "key_check_fk",
    "schema_items",
    "column_examples",
    "payload_rows",
    "feed_upsert",
    "stream_feed",
    "latest_per_entity",
    "gate_statements",
    "guarded_join_agg",
    "guarded_window",
    "rows_to_text",
    "result_csv_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"), int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # One small query starts the Python workers and compiles the common code paths.
    QUERIES["mmr_rerank"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
