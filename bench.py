"""Headline queries, one JSON line: median of three warm runs each, in seconds."""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans.registry import QUERIES  # noqa: E402

NAMES = ["r7_accuracy_by_subject", "j2_star_join", "a3_filtered_counts", "a15_profile", "w4_greedy_budget", "w5_stacked_periods", "d13_score_item", "d16_session_rollup", "m2_snapshot_diff", "p2_policy_reasons", "q1_validators", "q3_duplicate_index", "e1_trigram_locate", "r9_reconciliation_funnel", "r24_overview", "t1_window_counter"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in NAMES:
        times = []
        for _ in range(4):
            t = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        out[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": folder.rstrip("/").rpartition("/sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
