"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``engine_search`` is ``Engine.search`` for all benchmark texts over pages extracted once.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.engine import Engine
from corpusloom.operators import extract
from corpusloom.plans import registry
from corpusloom.sources import stores

HEADLINE = ("url_canonical", "tokenize", "token_stats", "bm25_docs", "bm25_passage_max", "aspect_coverage", "fusion_score", "host_cap_topk", "search_serp", "token_budget_prefix", "fingerprint_dedup", "cosine_topk", "page_main_text", "select_windows")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["url_canonical"](spark, sf_dir).count()  # starts the engine

    def timed(name: str, make) -> None:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: queries[name](spark, sf_dir))
    pages = f"{spark.conf.get('spark.checkpoint.dir')}/pages"
    stores.keyed(extract.pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).write.parquet(pages)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    timed("engine_search", lambda: Engine(extracted=spark.read.parquet(pages)).search(asked, today="2024-06-30"))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
