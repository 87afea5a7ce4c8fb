"""Time headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads, BENCH_RUNS the timed
runs per query (the median counts, after one run to warm up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gleanery.operators.storage import clear_stages  # noqa: E402
from gleanery.plans import all_queries  # noqa: E402

HEADLINE = (
    "agg_group_by", "agg_sum", "filter_and", "limit_rows", "rank_in_group", "field_profile", "validate_table",
    "duplicate_records", "entity_profile", "entity_match_primary", "text_line_blocks", "overlapping_chunks",
    "redact_phone", "keyword_retrieve", "vector_retrieve", "hybrid_retrieve",
    "region_safety", "tool_summary", "task_view")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    wanted = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    catalogue, seconds = all_queries(), {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalogue[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            clear_stages(spark)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
