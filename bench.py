"""Benchmark: run the headline asset queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to completion through the ``noop`` sink (all rows are
produced, nothing is collected to the driver).  Each query is run once to
warm up and then timed ``BENCH_REPEAT`` times (default 3, best time kept).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "explore_page", "list_assets", "total_count", "compose_filters", "display_view", "access_plan",
    "merge_columns", "kind_errors_per_asset", "asset_view_access", "validate_report", "check_name",
    "patch_assets", "replace_annotations", "parquet_metadata", "batch_admission",
    "register_assets", "register_tables", "table_view", "asset_detail",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from assetdeck.plans import all_queries
    from assetdeck.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app="assetdeck-bench")
    queries, _ = all_queries()
    names = only or HEADLINE
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        fn = queries[name]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            best = None
            for _ in range(repeat):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as exc:  # noqa: BLE001 - report and keep measuring the others
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
