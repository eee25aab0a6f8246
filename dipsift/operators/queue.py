"""Ranked queues, shortlists, sector bounds and queue profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit
from dipsift.operators.rank import quantiles, ranked


def _pinned(df: DataFrame) -> DataFrame:
    missing = [c for c in k.SHORTLIST_COLUMNS if c not in df.columns]
    if missing:
        raise KeyError(f"queue lacks pinned columns {missing}")
    return df.select(*k.SHORTLIST_COLUMNS)


def ranked_queue(scored: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Every event with its rank, in the fifteen pinned columns."""
    return _pinned(ranked(scored, "arm_b_score", tie))


def shortlist(scored: DataFrame, tie: Sequence[str], n: int = 50) -> DataFrame:
    """Head of the queue; a bounded top-n, so ranking it locally is cheap."""
    top = scored.orderBy(F.desc("arm_b_score"), *tie).limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("arm_b_score"), *tie)
    return _pinned(top.withColumn("rank", F.row_number().over(w)))


def output_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("tic").cast("string"), "event_time")


def rank_in_group(systems: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """Position by size inside a group of systems (one row per system); a group
    may hold most of them."""
    return ranked(systems.select(key, group, size), size, [key], "position", keys=[group]).select(key, group, "position")


def extended_sector_bounds(shipped: DataFrame, lc: DataFrame) -> DataFrame:
    """Shipped sector bounds plus measured ones for sectors beyond them, with a
    flag telling whether the sectors run 1..n without a hole."""
    new = (lc.groupBy("sector").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"))
           .join(shipped.select("sector"), "sector", "left_anti"))
    ext = shipped.unionByName(new)
    ok = ext.select(((F.min("sector") == 1) & (F.max("sector") == F.count(F.lit(1)))).cast("int")).scalar()
    return ext.withColumn("contiguous", ok)


def observed_baseline(lc: DataFrame) -> DataFrame:
    """Observed days per system: spans of its files added up."""
    return (lc.groupBy("tic", "sector").agg((F.max("time") - F.min("time")).alias("_s"))
            .groupBy("tic").agg(F.sum("_s").alias("t_obs")))


def queue_profile(events: DataFrame, by: Sequence[str], reference_rate: float) -> DataFrame:
    n, few = F.col("n_detrend_detections"), F.count(F.lit(1))
    counts = events.groupBy(*by).agg(
        few.alias("n_events"), F.countDistinct("tic", "sector").alias("n_files"),
        (F.count_if(n == k.DETREND_WINDOWS) / few).alias("share_ceiling"), (F.count_if(n <= 5) / few).alias("share_few"),
        F.count_if((F.col("det_dependence") == 1) != (n <= k.DETREND_ROBUST_ABOVE)).alias("n_inconsistent"))
    q = quantiles(events.withColumn("_n", n.cast("double")), list(by), "_n", {"median_n": 0.5, "p25_n": 0.25}).drop("n")
    rate = F.col("n_events") / F.col("n_files")
    return (counts.join(q, list(by)).withColumn("events_per_file", rate)
            .withColumn("rate_offset", F.abs(rate - lit(reference_rate)) / lit(reference_rate)))


def recovery_by_arm(tests: DataFrame) -> DataFrame:
    arm = lambda a: F.avg(F.when(F.col("inverted_lc") == a, F.col("recovered")))
    return tests.agg(arm(1).alias("inverted_recovery"), arm(0).alias("native_recovery"),
                     (F.abs(arm(1) - arm(0)) / F.avg("recovered")).alias("relative_difference"))
