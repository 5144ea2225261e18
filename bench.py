"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1), BENCH_CPUS: local cores
(default 8), BENCH_QUERIES: names, or "all". Each query runs once to warm up, then
BENCH_RUNS times (default 2); the best time counts. A time covers building the plan
and computing every row and column of the result.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridweave.plans import QUERIES  # noqa: E402
from gridweave.plans.common import local_session  # noqa: E402

HEADLINE = (
    "site_score page_issues page_links link_counts site_links broken_links page_text site_keywords sitemap normalized_urls "
    "upsert_orders transaction_keys insert_if_absent get_or_create slot_upsert replace_window expand_links flatten_report "
    "rows_to_array section_context section_progress section_quality first_client mentioned_parts workbook_diff filtered_documents "
    "typed_answers part_groups customer_groups message_stream"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split() or HEADLINE
    spark = local_session("bench")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(min(taken[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
