"""Plan report: physical-plan shape of every registered query.

``python -m revcast.plans.report [sf_dir] [names...]`` prints, per query,
the number of scans of each driver table, shuffle exchanges, broadcasts,
Python stages, and red flags (cartesian products, nested-loop joins,
row-at-a-time Python UDFs). Queries that run jobs while being built
(checkpoints, model fits, streams) are skipped unless named.
"""

from __future__ import annotations

import re
import sys

EAGER_PREFIXES = ("m1_", "m2_", "m6_model", "m7_", "m8_model", "m10", "m11", "m12", "m14",
                  "m15", "m16", "m19", "m20", "m22", "m24", "m25", "st", "s1_", "s3_", "s6_", "s7_", "u3",
                  "u4", "m23_feature")
TABLES = ["lineitem", "orders", "customer", "nation", "events"]
FLAGS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


def plan_stats(df, executed: bool = False) -> dict:
    """Counts in the plan; ``executed`` runs the query and looks at the plan that
    ran, in which an exchange that is used again counts once."""
    if executed:
        df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    out = {t: len(re.findall(rf"FileScan parquet [^\n]*/{t}\.parquet", plan)) for t in TABLES}
    out["shuffles"] = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|"
                                     r"Exchange RoundRobinPartitioning|Exchange SinglePartition", plan))
    out["broadcasts"] = plan.count("BroadcastExchange")
    out["python"] = len(re.findall(r"FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython", plan))
    out["flags"] = [f for f in FLAGS if f in plan]
    return out


def main(argv):
    from .. import plans
    from ..session import get_spark
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or [n for n in sorted(plans.QUERIES) if not n.startswith(EAGER_PREFIXES)]
    spark = get_spark()
    for n in names:
        s = plan_stats(plans.QUERIES[n](spark, sf_dir))
        scans = " ".join(f"{t}={s[t]}" for t in TABLES if s[t])
        print(f"{n:34s} {scans:40s} shuffles={s['shuffles']:<3d} broadcasts={s['broadcasts']:<2d} "
              f"python={s['python']} {' '.join(s['flags'])}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
