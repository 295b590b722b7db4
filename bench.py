"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the tables' folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lattica import api
from lattica import queries as own

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "q1_pricing", "find_filters", "find_sort_skip_limit", "distinct_values", "count_stage", "group_accumulators", "bucket_price", "facet_part",
    "lookup_unwind", "lookup_array", "lookup_semi", "lookup_pipeline_top", "window_rank", "window_time_range", "densify_daily", "expr_dates", "expr_strings",
    "expr_conditional_math", "update_ops", "diff_rows", "merge_three_way", "cdc_apply",
]


def small(spark: SparkSession):
    """The published micro benchmarks: 1,000 and 50,000 documents in memory."""
    from pyspark.sql import functions as F

    def docs(n: int):
        return spark.range(n).select(
            F.col("id").cast("int").alias("_id"), F.col("id").cast("int").alias("i"), (F.col("id") % 10).cast("int").alias("grp"),
            F.concat(F.lit("t"), F.col("id") % 7).alias("tag"), F.repeat(F.lit("x"), 64).alias("payload"),
        ).cache()

    d1, d50 = docs(1000), docs(50_000)
    d1.count(), d50.count()
    return {
        "find_filter_eq_50k": lambda: api.find(d50, {"grp": 3}),
        "agg_sort_1k": lambda: api.aggregate(d1, [{"$sort": {"i": -1}}, {"$limit": 100}]),
        "agg_match_group_1k": lambda: api.aggregate(d1, [{"$match": {"i": {"$gte": 0}}}, {"$group": {"_id": "$grp", "n": {"$sum": 1}, "s": {"$sum": "$i"}}}]),
        "count_documents_50k": lambda: api.aggregate(d50, [{"$match": {"i": {"$gte": 1000, "$lt": 6000}}}, {"$count": "n"}]),
        "distinct_50k": lambda: api.distinct(d50, "grp"),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: (lambda n=n: own.QUERIES[n](spark, SF_DIR)) for n in HEADLINE} | small(spark)
    times = {}
    for name, build in runs.items():
        best = None
        for _ in range(3):
            began = time.time()
            build().write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 4)
    print(json.dumps({"metric": "headline queries, best of 3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main()
