"""Scan the physical plan of every registered query for shapes that do not
scale: cartesian products, nested-loop joins and row-at-a-time Python UDFs.

Usage: python tools/check_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from tidemark.session import local_session
    spark = local_session()
    bad = {}
    from tidemark.catalog import spark_queries
    for key, fn in spark_queries().items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in FORBIDDEN if w in plan]
        if hits:
            bad[key] = hits
    print("forbidden shapes:", bad or "none")


if __name__ == "__main__":
    main()
