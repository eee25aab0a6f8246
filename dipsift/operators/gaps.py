"""Gap structure of observation series and tolerance grouping of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit
from dipsift.operators.ordered import SHARD_DAYS, islands, locate, running_total, with_neighbours

CURVE = ["tic", "sector"]


def gap_edges(lc: DataFrame, gap: float = k.GAP_BREAK_DAYS) -> DataFrame:
    """First and last cadence of every curve and both sides of each break;
    ``is_single`` marks the only cadence of a one-cadence curve."""
    n = with_neighbours(lc.select(*CURVE, "time"), CURVE, "time")
    after = F.coalesce(F.col("time") - F.col("_prev.time") > lit(gap), F.lit(True))
    before = F.coalesce(F.col("_next.time") - F.col("time") > lit(gap), F.lit(True))
    return n.where(after | before).select(
        *CURVE, "time", (F.col("_prev").isNull() & F.col("_next").isNull()).alias("is_single"))


def gap_distance(lc: DataFrame, points: DataFrame, at: str, gap: float = k.GAP_BREAK_DAYS,
                 name: str = "gap_proximity") -> DataFrame:
    """Days from each point to the nearest edge of its curve; NULL for curves
    with fewer than two cadences."""
    edges = (gap_edges(lc, gap).where("not is_single").drop("is_single")
             .withColumnRenamed("time", at))
    found = locate(edges, points, CURVE, at)
    return (found.withColumn(name, F.least(F.col(at) - F.col(f"prev.{at}"),
                                           F.col(f"next.{at}") - F.col(at)))
            .drop("n_lt", "n_le", "n_points", "prev", "next"))


def chunks(lc: DataFrame, gap: float = k.CHUNK_BREAK_DAYS) -> DataFrame:
    return islands(lc, CURVE, "time", gap, "chunk")


def sector_windows(spans: DataFrame, time_step: float = 0.01, slack: int = 1000,
                   cap: int = 189012) -> DataFrame:
    """Merges per-sector spans (tic, t_min, t_max) into simulation windows: a
    start more than 20 d after the previous end opens one; padded, snapped
    outward to the integration grid; ``over_cap`` flags windows needing too many
    points.  Spans per system are few, so they are scanned by start time."""
    n = with_neighbours(spans, ["tic"], "t_min", carry=["t_max"], width=400.0)
    flagged = n.withColumn("_open", F.coalesce(
        (F.col("t_min") - F.col("_prev.t_max") > lit(k.SPAN_BREAK_DAYS)).cast("int"), F.lit(0)))
    grouped = running_total(flagged, ["tic"], "t_min", F.col("_open"), "window_id", width=400.0)
    g = k.SPAN_GRID_PER_DAY
    return (grouped.groupBy("tic", "window_id")
            .agg(F.min("t_min").alias("_a"), F.max("t_max").alias("_z"),
                 F.count(F.lit(1)).alias("n_files"))
            .withColumn("t0", F.floor((F.col("_a") - lit(k.SPAN_PAD_DAYS)) * lit(g)) / lit(g))
            .withColumn("t1", F.ceil((F.col("_z") + lit(k.SPAN_PAD_DAYS)) * lit(g)) / lit(g))
            .withColumn("n_points", F.floor((F.col("t1") - F.col("t0")) / lit(time_step) + lit(slack)))
            .withColumn("over_cap", (F.col("n_points") >= cap).cast("int"))
            .drop("_a", "_z"))


def best_of_groups(peaks: DataFrame, tolerance: float, keys: Sequence[str] = tuple(CURVE),
                   at: str = "event_time", carry: Sequence[str] = (),
                   threshold: int = k.DETREND_ROBUST_ABOVE,
                   width: float = SHARD_DAYS, tie: Sequence[Column] = ()) -> DataFrame:
    """Chains peaks closer than ``tolerance`` and keeps the strongest of each
    chain (to nine digits; the earliest among equals, then the highest ``tie``), with
    the chain size and the dependence flag."""
    chained = islands(peaks, keys, at, tolerance, "group_id", width=width)
    best = F.max_by(F.struct(at, "snr", *carry), F.struct(F.round("snr", 9), -F.col(at), *tie))
    return (chained.groupBy(*keys, "group_id")
            .agg(best.alias("_best"), F.count(F.lit(1)).alias("n_detrend_detections"))
            .select(*keys, "group_id", "_best.*", "n_detrend_detections",
                    F.when(F.col("n_detrend_detections") <= threshold, 1).otherwise(0)
                    .alias("det_dependence")))


def duplicate_groups(events: DataFrame, tolerance: float = k.DUPLICATE_TOLERANCE_DAYS,
                     keys: Sequence[str] = tuple(CURVE), at: str = "event_time",
                     row_id: str = "event_id") -> DataFrame:
    """Every event with its duplicate group, the group's size and whether it is
    the canonical (highest SNR) member; size is metadata only."""
    chained = islands(events, keys, at, tolerance, "group_id")
    best = (chained.groupBy(*keys, "group_id")
            .agg(F.count(F.lit(1)).alias("multiplicity"),
                 F.max(F.struct(F.col("snr"), (-F.col(at)).alias("_t"),
                                F.col(row_id).alias("_id"))).alias("_top")))
    return (chained.join(best, [*keys, "group_id"])
            .withColumn("is_canonical", (F.col(row_id) == F.col("_top._id")).cast("int"))
            .drop("_top"))


def dip_runs(lc: DataFrame, threshold: float, row_id: str = "event_id") -> DataFrame:
    """One row per run of contiguous cadences below ``threshold``: the time of
    its deepest cadence (first among equals) and the run length."""
    n = with_neighbours(lc.withColumn("_below", F.col("flux") < lit(threshold)), CURVE, "time", ["_below"])
    starts = (F.col("_below") & ~F.coalesce(F.col("_prev._below"), F.lit(False))).cast("bigint")
    runs = running_total(n.drop("_next"), CURVE, "time", starts, "run_id")
    deepest = F.min(F.struct("flux", "time"))
    return (runs.where("_below").groupBy(*CURVE, "run_id")
            .agg(deepest.alias("_d"), F.count(F.lit(1)).alias("n_cadences"))
            .select(*CURVE, "run_id", F.col("_d.time").alias("time"),
                    F.col("_d.flux").alias("flux"), "n_cadences"))
