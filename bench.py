"""Time the headline queries and print one line of JSON.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
The tables a run finds in place (ledger, caches, answers) are written before
the clock starts; every query then runs in full, to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from filewright.workload import corpus  # noqa: E402
from filewright.workload.registered import QUERIES  # noqa: E402

HEADLINE = (
    "organize_run",
    "duplicates_in_run",
    "duplicate_lookup",
    "cache_lookup",
    "extraction_cache_lookup",
    "model_workload",
    "keywords_topk",
    "understand_fallback",
    "rule_classify",
    "typed_classification",
    "taxonomy_align",
    "unique_destinations",
    "benchmark_report",
    "run_metrics",
    "stats_overall",
    "html_strip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    corpus.tables(spark, folder)
    for build in (corpus.benchmark_labels, corpus.movements, corpus.plan):
        build(spark, folder)

    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    documents = corpus.current_files(spark, folder).count()
    small = Path(folder).with_name("sf0.01")
    if small.exists() and small != Path(folder):
        corpus.tables(spark, str(small))
        begin = time.perf_counter()
        QUERIES["organize_run"](spark, str(small)).write.format("noop").mode("overwrite").save()
        smaller = {"organize_run_sf0.01": round(time.perf_counter() - begin, 3)}
    else:
        smaller = {}
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
        "documents_per_second": round(documents / times["organize_run"], 1),
        **smaller,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
