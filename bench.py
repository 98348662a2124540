"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from symloom.plans import queries as core

HEADLINE = [
    "search_single", "search_and", "search_batch", "lookup_cascade_batch", "lookup_suffix", "lookup_all_names", "suggest_topk", "tree_recursive", "group_by_module", "type_children",
    "impls_sorted", "suffix_explode", "reexport_prefix", "reexport_glob", "version_resolve", "summary_text", "truncate_text", "markdown_strip",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    core._full(spark, sf)
    core._full(spark, sf, True)
    times = {"index_build": round(time.time() - began, 3)}
    for name in HEADLINE:
        began = time.time()
        core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
