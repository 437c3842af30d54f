"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from gridweave.plans import load
from gridweave.session import local_session

HEADLINE = [
    "calc_basic", "calc_grouped", "calc_ratio", "calc_trend", "calc_cross_sheet", "calc_spec", "time_filter_fallback", "result_rows",
    "detect_header", "sheet_profile", "row_blocks", "keyed_fill", "keyed_filled", "append_rows", "candidate_writes", "merged_guard", "review_merge",
    "label_match", "segments", "doc_rank", "budget_select", "extract_summary", "pillar_coverage", "topic_matrix", "kpi_extract", "disclosure_matrix",
    "evidence_links", "latest_per_key",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    catalog = load()

    def run(name: str) -> float:
        start = time.time()
        catalog.queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    times: dict[str, float] = {}
    for name in HEADLINE:
        run(name)  # warm-up: code generation and file listing
        times[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": cores,
    }))


if __name__ == "__main__":
    main()
