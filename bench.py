"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line with the warm median seconds of each."""

from __future__ import annotations

import json
import os
import re
import statistics
import time

CPUS = os.environ.get("BENCH_CPUS", "8")
FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ("flagship", "stress_full_agg", "stress_high_card_gb", "stress_large_sort", "stress_join_2way", "stress_join_3way", "stress_filtered_expr", "stress_window", "stress_nested_cte", "j8_multi_join", "a4_rollup", "o5_distinct_on", "w15_groups_frame", "o6_nearest", "p17_in_subquery", "time_buckets")


def main() -> None:
    from lakeloom.plans import analytic, basic, changes, registry, scalars  # noqa: F401
    from lakeloom.session import session

    spark = session(f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 4)
    found = re.search(r"sf([0-9.]+)", FOLDER)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(found[1]) if found else FOLDER}))


if __name__ == "__main__":
    main()
