"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all]
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "flagship_host_links", "s1_page_records", "f7_page_text", "f9_page_markdown", "f11_page_metadata",
    "p4_resolved_links", "f4_clean_markdown", "f6_flatten_tables", "d1_classify", "d2_apply", "d4_delete",
    "w1_newest_per_hash", "w6_version_numbers", "w5_stalled", "o5_offset_batches", "a4_index_stats",
    "a5b_list_metrics", "g2_crawl_plan", "j7_glossary_matches", "j9_due_by_site", "v1_token_window_chunks",
    "v2_dense_vectors", "v3_sparse_vectors", "v4_dense_cosine", "v5_sparse_search", "v6_hybrid_search",
    "v10_semantic_search", "t1_stage_stream", "t4_task_states_stream",
]


def main(argv: list[str]) -> None:
    from pageloom.plans import catalog
    from pageloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    names = list(catalog.QUERIES) if "--all" in argv else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if "--all" in argv:
            print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    report = {
        "metric": "total wall time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if "f9_page_markdown" in times:
        report["pages_per_sec_markdown"] = round(pages / times["f9_page_markdown"], 1)
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
