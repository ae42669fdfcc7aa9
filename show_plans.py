"""Summarise the physical plans of the headline queries into PLANS.md.

For each query: the parquet scans with the columns they read and the
filters pushed into them, the number of shuffles and broadcasts, the join
strategies, windows and Python steps of ``explain("formatted")``.
Usage: ``python show_plans.py [sf_dir] > PLANS.md``.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.session import local_session  # noqa: E402

KEYS = ["user_analytics", "productivity_insights", "productivity_analytics", "smart_parse", "search_tasks",
        "archive_cascade", "ttl_dedup", "constraint_violations", "task_list", "priority_window_count",
        "context_tasks", "change_notifications"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(text: str) -> list[str]:
    lines = []
    scans = re.findall(r"\(\d+\) Scan parquet\s*\n(.*?)(?=\n\(\d+\)|\Z)", text, re.S)
    for body in scans:
        loc = re.search(r"Location: \S+ \[file:[^\]]*/([a-z_]+)\.parquet\]", body)
        schema = re.search(r"ReadSchema: struct<(.*)>", body)
        pushed = re.search(r"PushedFilters: \[(.*)\]", body)
        cols = [c.split(":")[0] for c in schema.group(1).split(",")] if schema else []
        lines.append(f"- scan `{loc.group(1) if loc else '?'}` reads {', '.join(cols)}"
                     + (f"; pushed: {pushed.group(1)}" if pushed and pushed.group(1) else ""))
    ops = {
        "shuffles": len(re.findall(r"\) Exchange\b", text)),
        "broadcasts": len(re.findall(r"\) BroadcastExchange\b", text)),
        "broadcast hash joins": len(re.findall(r"\) BroadcastHashJoin\b", text)),
        "sort-merge joins": len(re.findall(r"\) SortMergeJoin\b", text)),
        "hash aggregates": len(re.findall(r"\) (?:HashAggregate|ObjectHashAggregate)\b", text)),
        "window group limits": len(re.findall(r"\) WindowGroupLimit\b", text)),
        "windows": len(re.findall(r"\) Window\b", text)),
        "Python (pandas) steps": len(re.findall(r"\) (?:MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython)", text)),
    }
    lines.append("- " + ", ".join(f"{k}: {v}" for k, v in ops.items()))
    return lines


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    from tidemark.plans.registry import load_all
    reg = load_all()
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `python show_plans.py {sf}` (initial adaptive plans; AQE may still turn a "
          "sort-merge join into a broadcast join or coalesce partitions at run time).\n")
    for k in KEYS:
        df = reg[k].build(spark, sf)
        print(f"## {k}\n")
        print("\n".join(summarise(plan_text(df))))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
