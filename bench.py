"""Timing of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is run to the end into a sink that discards rows: once to warm up
and then ``BENCH_RUNS`` times; the median counts. One JSON line is printed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from placewright.catalog.queries import QUERIES  # noqa: E402
from placewright.session import build_session  # noqa: E402

HEADLINE = [
    "topk_similar",
    "match_resumes",
    "similarity_pairs",
    "compatible_jobs",
    "filter_funnel",
    "ingest_postings",
    "ingest_new_ids",
    "parse_posting_details",
    "upsert_metadata",
    "validate_extractions",
    "extract_batch",
    "extract_languages",
    "extraction_accuracy",
    "enrich_gaps",
    "embed_documents",
    "latest_status",
    "merge_artifacts",
    "processing_state",
    "fit_report",
    "handoff_text",
    "incremental_ingest",
    "incremental_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "placewright-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
