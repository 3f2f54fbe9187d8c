"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each workload is run to completion into a no-op sink; one JSON line is printed.
Arguments name the workloads to run (default: all headline ones; any
registered query name is accepted too).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import index as ix
from codequarry.operators import ranking as rk
from codequarry.plans import catalog as cat
from codequarry.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
N_QUERIES = 100


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of a few words each: the first sentences of the benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter(F.col("item_id") < N_QUERIES)
    words = F.slice(F.split("text", r"\s+"), 4, 3)
    return items.select(F.col("item_id").cast("string").alias("query_id"), F.array_join(words, " ").alias("query"))


def index_build(spark: SparkSession, sf_dir: str) -> None:
    index = ix.build_index(cat._docs(spark, sf_dir), persist=True)
    drain(index.vocab)
    drain(index.field_stats)


def ranked_100(spark: SparkSession, sf_dir: str) -> None:
    index = ix.build_index(cat._docs(spark, sf_dir), persist=True)
    drain(rk.search_ranked(index, word_queries(spark, sf_dir)))


HEADLINE = {
    "search_regex": None, "search_multi_query": None, "search_literal_table": None,
    "index_build": index_build, "ranked_100": ranked_100, "rank_key_lines": None,
    "outline_kind_counts": None, "imports_extracted": None, "impact_counts": None,
    "tree_dirs": None, "patch_status_counts": None, "diff_stat": None,
}


def main() -> None:
    spark = local_session(CPUS, "bench", memory=os.environ.get("BENCH_MEMORY", "20g"))
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()  # start-up is not measured
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        work = HEADLINE.get(name)
        if work is None:
            drain(cat.QUERIES[name](spark, SF_DIR))
        else:
            work(spark, SF_DIR)
        times[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
