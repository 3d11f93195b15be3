"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tokengraph.plans.catalogue import QUERIES
from tokengraph.session import local_session

HEADLINE = [
    "entity_counts_by_type",
    "tokenize_text",
    "overlap_score_first",
    "injection_scan",
    "sentence_split",
    "pipe_table_rows",
    "table_unpivot",
    "composite_facts",
    "vault_roundtrip",
    "text_triples",
    "graph_edges_dedup",
    "khop_neighbors",
    "query_subgraph",
    "audit_chain",
    "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors before the first clock
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs) if repeats < 3 else statistics.median(runs), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
