"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: What the baseline names: clustered filter, top-K, percentiles, distinct counts, many groups, full profile, joins.
HEADLINE = [
    "filter_temporal", "topk_tiebreak", "agg_p99", "agg_count_distinct", "agg_sum", "agg_many_groups", "agg_quantiles_many_groups", "agg_two_keys_filtered", "rollup_3", "cube_3", "rollup_spread", "pivot_multi_metric", "pivot_other",
    "agg_mode_firstseen", "join_chain3", "join_estimate", "profile_all_columns", "profile_hist24", "diff_counts", "footer_columns", "flagship",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestone.queries import QUERIES

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
