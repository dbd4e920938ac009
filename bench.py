"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

from atalaya.plans import all_queries
from atalaya.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "normalize_status parse_dates_es normalize_calls filter_relevant filter_live dedupe_last "
    "detect_changes upsert_calls monitor_run exclude_patterns source_overview quality_report kpis "
    "briefing page_calls call_detail notification_fanout notification_result render_messages "
    "consolidate_pages_short extract_json extract_feed extract_html extract_news extract_by_rules clean_pages page_links "
    "group_merge_regions responses_to_items pack_context find_dates step_metrics "
    "retention_purge cascade_delete content_changed stream_counts stream_changes"
).split()


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    for warm in ("kpis", "clean_pages"):
        queries[warm](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
