"""Write PLANS.md: physical-plan properties of every registered query.

Usage:  python tests/plan_audit.py [sf_dir]

For each query the executed plan (after AQE, from a real run) is searched for
shuffles, join strategies, per-group limits, Python stages and filters pushed
into parquet scans.
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def audit(df) -> dict:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = [p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
              if p and not all(x.strip().startswith("IsNotNull") for x in p.split(","))]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "group_limit": "WindowGroupLimit" in plan,
        "python": any(k in plan for k in ("MapInPandas", "FlatMapGroupsInPandas", "MapInArrow",
                                          "GroupsInArrow", "ArrowEvalPython")),
        "pushed": len(pushed),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    import __spark_entry__ as entry
    from stockfair.session import get_session

    spark = get_session(shuffle_partitions=8)
    rows = []
    for name, fn in entry.queries().items():
        began = time.perf_counter()
        try:
            a = audit(fn(spark, sf_dir))
            a["sec"] = round(time.perf_counter() - began, 1)
        except Exception as e:  # streams read back from their sink, etc.
            a = {"error": type(e).__name__}
        rows.append((name, a))
        print(name, a, flush=True)
    out = ["# Physical plans of the registered queries", "",
           f"Executed plans (after AQE) at `{sf_dir}`, `local[8]`, 8 shuffle partitions, "
           "written by `tests/plan_audit.py`.  Columns: shuffle exchanges, broadcast hash "
           "joins, sort-merge joins, per-group limit before the shuffle, Python stage in the "
           "plan, parquet scans with pushed (non-null-check) filters.  Checkpointed inputs "
           "show only the plan after the checkpoint; stream queries show the read-back.  "
           "Seconds include the jobs run while the plan is built.", "",
           "| query | shuffles | broadcast | sort-merge | group limit | python | pushed | seconds |",
           "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    for name, a in rows:
        if "error" in a:
            out.append(f"| {name} | {a['error']} | | | | | | |")
            continue
        out.append(f"| {name} | {a['shuffles']} | {a['broadcast_joins']} | "
                   f"{a['sort_merge_joins']} | {'yes' if a['group_limit'] else ''} | "
                   f"{'yes' if a['python'] else ''} | {a['pushed']} | {a['sec']} |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main(sys.argv)
