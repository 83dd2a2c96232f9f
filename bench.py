"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from codeloom.plans import catalogue

HEADLINE = ("resolve_calls", "rank_symbols", "fan_in_out", "adjacency", "file_pairs", "file_cycles",
            "repo_findings", "reach_depth", "chunk_headers", "chunk_windows", "vector_topk",
            "ungrounded_words", "call_stats", "parse_python", "self_call_mro")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalogue.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in only:
        start = time.monotonic()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.monotonic() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
