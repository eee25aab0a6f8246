"""Times the headline queries and prints one JSON line."""
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["a20_operating_point_recall", "a21_matched_recall", "a26_ranking_quality", "w1_event_gap_distance",
            "w4_tolerance_grouping", "j2_event_windows", "a2_local_view", "j3_fold_join", "a4_recurrence_scalars",
            "j4_nearest_partner", "j5_recovery_by_test", "j8_blocked_cadences", "j11_incumbent_block", "k1_ranked_queue",
            "r7_stratified_split", "r11_injected_flux", "w7_search_events", "p15_record_scalars", "r4_matched_epochs", "a5_noise_screen",
            "a22_cluster_bootstrap", "s1_curve_scan"]


def main():
    from pyspark.sql import SparkSession

    from dipsift import plans
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    queries, times = plans.queries(), {}
    queries["p9_operating_points"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
