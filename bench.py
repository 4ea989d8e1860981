"""Time the headline queries: one warm-up, then the median of the timed runs.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed
runs per query), BENCH_QUERIES (comma-separated names instead of the headline
list). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loomwork import catalog  # noqa: E402
from loomwork.session import build_session  # noqa: E402

HEADLINE = [
    # whole-dataset jobs
    "inclusion_dependencies", "attr_overlap", "unique_combinations",
    "unique_combinations_orders", "unique_combinations_lineitem", "lattice_verdicts",
    "longest_shared_substring", "longest_shared_substring_text",
    "primes_in_range", "prime_keys", "hint_elimination", "record_resolution", "lww_merge",
    # operators
    "scan_filter_contains", "sql_filter_topk", "broadcast_semi", "top_row_per_group",
    "top_row_window", "conditional_counts", "theta_self_join", "set_algebra", "digest_join",
    "bitmap_cardinality", "bloom_semi_join", "pair_lcs", "value_attr_sets",
    "bitmap_common", "bitmap_ranges", "reduce_column",
    "csv_dialect", "csv_multiline", "csv_inclusion", "lww_stream",
    "tree_accuracy",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("loomwork-bench", f"local[{cpus}]", cpus, {
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1],
        "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
