"""Headline-query benchmark.

Runs the headline operators on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed in full with the ``noop`` sink (no collect to the
driver); a small warm-up query runs first so JVM start-up is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.session import local_session  # noqa: E402

HEADLINE = {
    # name -> builder(spark, sf_dir) -> DataFrame
    "user_analytics": "user_analytics_record",
    "productivity_insights": "productivity_insights_record",
    "productivity_analytics": "productivity_analytics",
    "smart_parse": "smart_parse",
    "search_tasks": "search_tasks",
    "archive_cascade": "archive_cascade",
    "ttl_dedup": "ttl_dedup",
    "constraint_violations": "constraint_violations",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")),
                          app="tidemark-bench")
    from tidemark.plans.registry import load_all
    reg = {k: q.build for k, q in load_all().items()}

    # warm-up: JVM, parquet reader, Python workers
    reg["user_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name, key in HEADLINE.items():
        t0 = time.time()
        reg[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
