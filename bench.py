"""Times the headline queries, each with cold code and again warm, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pressroute.queries import QUERIES
from pressroute.session import local_session

HEADLINE = [
    "manifest_by_date", "draw_by_manifest_day", "sales_history", "weekly_net_by_zip", "week_over_week", "join_star",
    "join_self_overlap", "draw_entry", "threshold_dates", "returns_audit_wide", "run_durations", "process_summary",
    "upsert_import", "upsert_import_history", "dedupe_keep_first", "pivot_case_weekday", "zero_months", "export_delta",
    "fill_gaps", "account_dump", "latest_by_max_time", "row_number_global", "version_delta", "densify_facts",
    "duplicate_requests", "subscribers_by_plan",
]


def took(spark, base: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["group_agg"](spark, base).write.format("noop").mode("overwrite").save()  # start the engine, read the footers
    cold, warm = ({name: took(spark, base, name) for name in HEADLINE} for _ in range(2))
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(cold.values()), 3), "unit": "sec",
                      "queries": cold, "warm": warm, "warm_value": round(sum(warm.values()), 3),
                      "sf": os.path.basename(base.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
