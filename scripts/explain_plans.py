"""Print the physical plan of registered queries and flag plan shapes that do not scale.

    python scripts/explain_plans.py [sf_dir] [name ...]

For each query: number of shuffles (Exchange), broadcast and sort-merge joins,
sort-based aggregates, file scans, and any cartesian product, nested-loop join
or row-at-a-time Python UDF (there should be none).  With names given, the full
``explain("formatted")`` output is printed as well.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assetdeck.plans import all_queries  # noqa: E402
from assetdeck.session import build_session  # noqa: E402

ITERATIVE = {"batch_admission", "register_assets", "register_tables", "admit_assets", "admit_tables", "append_snapshot",
             "registration_intake"}
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not a.startswith("/")]
    spark = build_session()
    queries, _ = all_queries()
    for name, fn in queries.items():
        if (only and name not in only) or (not only and name in ITERATIVE):
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        stats = {
            "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
            "bhj": plan.count("BroadcastHashJoin"), "smj": plan.count("SortMergeJoin"),
            "sort_agg": plan.count("SortAggregate"), "scans": plan.count("FileScan"),
        }
        flags = [b for b in BAD if b in plan]
        print(f"{name:28s} " + " ".join(f"{k}={v}" for k, v in stats.items()) + ("  !! " + ",".join(flags) if flags else ""))
        if only:
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
