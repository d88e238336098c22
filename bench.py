"""Headline-query bench: prints one JSON line.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]``: one warm-up run, then the median of three timed
runs. A run executes the whole plan into Spark's ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codelens.plans.registry import load_all  # noqa: E402
from codelens.session import local_session  # noqa: E402

HEADLINE = ["rul_security", "agg_analysis", "agg_health", "err_classify", "win_context",
            "join_lineage", "dep_all", "flt_search"]


def run_once(fn, spark, sf_dir) -> float:
    t = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus=cpus, shuffle_partitions=max(8, cpus))
    registry = load_all()
    for name in HEADLINE:  # warm-up pass over every query (JVM JIT, file listing, code generation)
        run_once(registry[name][0], spark, sf_dir)
    samples: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for _ in range(repeats):  # timed rounds, queries interleaved
        for name in HEADLINE:
            samples[name].append(run_once(registry[name][0], spark, sf_dir))
    times = {name: round(statistics.median(s), 3) for name, s in samples.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
