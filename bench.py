"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and fully written to the ``noop`` sink: one warm-up, then
the median of $BENCH_RUNS runs (3 unless set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from labelmx.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "subset_where", "subset_both", "subset_labels", "propagate_subset", "obs_vector", "to_wide", "transpose",
    "pack_rows", "densify", "assign_block", "make_names_unique", "strings_to_categories",
    "concat_same_axis", "concat_obs", "fill_missing", "merge_unique", "merge_nested_unique",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("labelmx-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds, failed = {}, {}
    for name in names:
        taken = []
        try:
            for _ in range(runs + 1):
                start = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
        except Exception as error:  # the other queries still give their figures
            failed[name] = str(error).partition("\n")[0][:300]
            print(f"{name}: failed, {failed[name]}", file=sys.stderr)
            continue
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    } | ({"failed": failed} if failed else {})))
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
