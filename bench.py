"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR is the scale folder, BENCH_CPUS the number of local cores, BENCH_RUNS the timed runs per query
(after one warm-up); the median is reported. Results go to the no-op sink, so every row is computed. Training-data operators
run once each, where they are there; their times stand apart and are no part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trend_detection",
    "observation_tracking",
    "observation_values",
    "out_of_range_flags",
    "duplicate_clusters",
    "last_write_wins",
    "medication_table",
    "unified_records",
    "reference_resolution",
    "explicit_edges",
    "observation_conditions",
    "compact_concepts",
    "deterministic_groups",
    "friendly_names",
    "medication_conditions",
    "code_weights",
    "best_lookup_rows",
    "whole_word_names",
    "text_search",
    "nearest_centroid",
    "condition_scores",
    "price_quartiles",
    "top_items",
    "directory_search",
]

TRAINING_DATA = ["op1_benchmark_hits", "op5_hash_tree_shards", "op8_simhash_groups", "op11_spelling_variants", "op12_chat_repair", "op13_odd_sketch_groups"]


def once(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def training_data_times(spark, sf_dir: str) -> dict[str, float]:
    try:
        from recordloom.llm.queries import QUERIES
    except ImportError:
        return {}
    times = {}
    for name in TRAINING_DATA:
        times[name] = round(once(spark, QUERIES[name], sf_dir), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from recordloom.plans.catalog import QUERIES
    from recordloom.session import build_session

    spark = build_session(
        "recordloom-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.log.structuredLogging.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        taken = [once(spark, QUERIES[name], sf_dir) for _ in range(runs + 1)]
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    training = {} if wanted else training_data_times(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "training_data_queries": training, "sf": os.path.basename(sf_dir.rstrip("/")), "lineitem_rows": rows, "cpus": cpus}))


if __name__ == "__main__":
    main()
