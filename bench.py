"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is run to completion into a sink that discards the rows: once to warm up, then
BENCH_RUNS times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilake.registry.queries import QUERIES  # noqa: E402

HEADLINE = [
    "sorted_findings", "rule_counts", "severity_summary", "rule_line_match", "rules_secrets", "rules_config",
    "rules_python_injection", "rules_dotenv", "route_no_auth", "html_script_rules", "ignore_filter", "line_numbering",
    "baseline_filter", "duplicate_fingerprints", "finding_index", "findings_by_file", "verdict_join", "review_batch_sink",
    "findings_json_sink", "sarif_sink", "detection_scorecard", "stack_signal_join", "stack_recommendations",
    "rule_validate", "nearest_git_root", "change_detect", "debounce", "stream_scan", "stream_baseline_filter", "repo_rules",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session()

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chars = documents.selectExpr("sum(n_chars)").first()[0]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": spark.sparkContext.defaultParallelism, "document_chars": chars}))
    spark.stop()


if __name__ == "__main__":
    main()
