"""Time the headline queries: one warm-up, then the median of two runs each; prints one JSON line.

BENCH_SF_DIR  folder with the sample tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_QUERIES comma-separated query names (default: the list below); "all" runs every query
BENCH_RUNS    timed runs per query (default 2)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from leadlake.session import build_session, local_cpus

HEADLINE = [
    "dashboard_metrics", "leads_by_month", "source_metrics", "quality_scores", "facets", "facets_q", "comprehensive_report",
    "filter_search", "postings", "posting_lists", "token_intersection", "index_metadata", "search_ranked", "search_full_text", "search_with_postings",
    "search_batch", "estimated_results", "suggestions", "query_analysis", "search_summary", "popular_queries", "session_counters",
    "lead_counters", "funnel", "activity_feed", "click_attribution", "apply_changes", "validate_leads", "email_extract",
    "frequency_keywords", "page_extract", "page_merge", "lead_pipeline", "import_leads", "dedupe_exact", "stream_search_sessions",
]


def drain(df) -> None:
    """Run the whole plan without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = local_cpus()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from leadlake.catalog.queries import QUERIES

    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else list(QUERIES) if chosen == "all" else chosen.split(",")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            drain(QUERIES[name](spark, sf_dir))
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name:28s} {times[name]:8.3f}  (first {taken[0]:.3f})", file=sys.stderr, flush=True)
    result = {
        "metric": "total_time_of_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    leads, pages = spark.read.parquet(f"{sf_dir}/customer.parquet").count(), spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    if times.get("index_metadata"):
        result["leads_indexed_per_sec"] = round(leads / times["index_metadata"])
    if times.get("page_extract"):
        result["pages_extracted_per_sec"] = round(pages / times["page_extract"])
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
