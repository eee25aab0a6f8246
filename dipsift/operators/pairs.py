"""Nearest partners, crossing pairs, neighbouring samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit, pair_window
from dipsift.operators.ordered import locate, running_total, with_neighbours


def nearest_partner(events: DataFrame, group: Sequence[str], event_key: str = "event_id") -> DataFrame:
    """Nearest other event of the same group whose spacing lies in the pair
    window of the event, with the candidate count.

    No event pairs are formed: each event asks a sorted lookup for the bounds of
    its two windows, so a group of n events costs n log n, whatever the window.
    ``events``: group, event_key, event_time, duration, depth, period."""
    lo, hi = pair_window(F.col("period"), F.col("duration"))
    asked = (events.where(F.col("duration").isNotNull() & (F.col("duration") > 0))
             .withColumns({"_lo": lo, "_hi": hi}).where(F.col("_hi") > F.col("_lo")))
    far_before, near_before, near_after, far_after = range(4)
    probes = F.array(-F.col("_hi"), -F.col("_lo"), F.col("_lo"), F.col("_hi"))
    # Probes are narrow; what else is needed of the event comes back with the last join.
    queries = (asked.select(*group, event_key, "event_time", F.posexplode(probes).alias("_side", "_d"))
               .select(*group, event_key, "_side", (F.col("event_time") + F.col("_d")).alias("event_time")))
    points = (events.where(F.col("duration") > 0)
              .select(*group, "event_time", "duration", "depth"))
    hit = locate(points, queries, group, "event_time", ["duration", "depth"])

    def of(side: int, c):
        return F.max(F.when(F.col("_side") == side, c))

    got = (hit.groupBy(*group, event_key)
           .agg(of(far_before, F.col("n_lt")).alias("_n1"), of(near_before, F.col("n_le")).alias("_n2"),
                of(near_after, F.col("n_lt")).alias("_n3"), of(far_after, F.col("n_le")).alias("_n4"),
                of(near_before, F.col("prev")).alias("_p"), of(near_after, F.col("next")).alias("_q")))
    dp, dq = F.col("event_time") - F.col("_p.event_time"), F.col("_q.event_time") - F.col("event_time")
    found = events.join(got, [*group, event_key], "left").withColumn("_hi", hi).withColumns({
        "_dp": F.when(dp <= F.col("_hi"), dp), "_dq": F.when(dq <= F.col("_hi"), dq)})
    earlier = F.col("_dp").isNotNull() & (F.col("_dq").isNull() | (F.col("_dp") <= F.col("_dq")))
    other = F.when(earlier, F.col("_p")).when(F.col("_dq").isNotNull(), F.col("_q"))
    return (found.withColumn("_o", other).select(
        *events.columns, F.when(earlier, F.col("_dp")).otherwise(F.col("_dq")).alias("partner_dt"),
        F.when(F.col("_o").isNotNull(), F.least("duration", "_o.duration") / F.greatest("duration", "_o.duration")).alias("pair_duration_ratio"),
        F.col("_o.depth").alias("partner_depth"),
        F.coalesce(F.col("_n2") - F.col("_n1") + F.col("_n4") - F.col("_n3"), F.lit(0)).alias("n_candidates")))


def observed_pair_scalars(partnered: DataFrame, depth_ratio: str) -> DataFrame:
    """The four pair features, from flagged events only."""
    from dipsift.functions.expr import pair_depth_log_ratio
    seen = F.when(F.col("depth") > 0, F.col("partner_depth") / F.col("depth"))
    return partnered.withColumns({
        "has_observed_pair": F.col("partner_dt").isNotNull().cast("double"),
        "pair_dt_over_pbin": F.col("partner_dt") / F.col("period"),
        "pairing_depth_ratio_vs_expectation": pair_depth_log_ratio(seen, F.col(depth_ratio))})


def crossing_pairs(crossings: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per conjunction: smallest spacing between crossings of different stars and
    whether it lies in the pair window of the median crossing duration.

    The closest cross-star pair is always adjacent in time order, so neighbours
    suffice and no star-1 x star-2 product is built."""
    dur = F.col("egress") - F.col("ingress")
    near = with_neighbours(crossings, group, "time", ["star"])
    step = F.when(F.col("_prev.star") != F.col("star"), F.col("time") - F.col("_prev.time"))
    out = (near.groupBy(*group)
           .agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("star").alias("n_stars"),
                F.min(step).alias("dt"), F.median(dur).alias("_dur"),
                F.max("period").alias("period"),
                F.min_by("depth", F.when(F.col("star") == 1, F.col("time"))).alias("d1"),
                F.min_by("depth", F.when(F.col("star") == 2, F.col("time"))).alias("d2"),
                (F.greatest(F.count_if(F.col("star") == 1), F.count_if(F.col("star") == 2)) >= 2)
                .cast("int").alias("same_star_multiple")))
    lo, hi = pair_window(F.col("period"), F.col("_dur"))
    is_pair = F.coalesce((hi > lo) & (F.col("dt") >= lo) & (F.col("dt") <= hi), F.lit(False))
    return (out.withColumn("is_pair", is_pair.cast("int"))
            .withColumn("dt_over_pbin", F.when(F.col("is_pair") == 1, F.col("dt") / F.col("period")))
            .withColumn("depth_ratio_seen", F.when((F.col("is_pair") == 1) & (F.col("d1") > 0),
                                                   F.col("d2") / F.col("d1")))
            .drop("_dur", "d1", "d2"))


def next_sample(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For every left sample the next-or-equal right sample (the last one when
    none follows), as a sorted-array insertion point does."""
    hit = locate(right, left, keys, at, [value])
    other = F.coalesce(F.col("next"), F.col("prev"))
    return (hit.withColumn("dt", F.abs(other.getField(at) - F.col(at)))
            .withColumn("other_value", other.getField(value))
            .drop("n_lt", "n_le", "n_points", "prev", "next"))


def nearest_gap(points: DataFrame, queries: DataFrame, keys: Sequence[str], at: str,
                name: str) -> DataFrame:
    """Adds the distance from each query to the nearest point (NULL without any)."""
    hit = locate(points, queries, keys, at)
    gap = F.least(F.col(at) - F.col(f"prev.{at}"), F.col(f"next.{at}") - F.col(at))
    return hit.withColumn(name, gap).drop("n_lt", "n_le", "n_points", "prev", "next")


def within_cadence(points: DataFrame, queries: DataFrame, keys: Sequence[str], at: str,
                   cadence: float = k.CADENCE_DAYS) -> DataFrame:
    """Queries that have a point strictly closer than one cadence."""
    return nearest_gap(points, queries, keys, at, "_gap").where(F.col("_gap") < lit(cadence)).drop("_gap")


def covered(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str,
            lo: str, hi: str, closed: bool = False) -> DataFrame:
    """Adds ``covered`` (1/0): the point lies inside at least one interval (open
    bounds unless ``closed``).  Starts and ends are running totals in one order with the points,
    so overlapping intervals cost nothing extra and the points are shuffled once."""
    starts = intervals.select(*keys, F.col(lo).alias(at), F.lit(1).alias("_open"))
    ends = intervals.select(*keys, F.col(hi).alias(at), F.lit(-1).alias("_open"))
    # Among equals: open intervals end before a point and begin behind it, closed ones the other way round.
    turn = F.when(F.col("_open") == 0, 1).when(F.col("_open") == (1 if closed else -1), 0).otherwise(2)
    merged = points.withColumn("_open", F.lit(0)).unionByName(
        starts.unionByName(ends).where(F.col(at).isNotNull()), allowMissingColumns=True).withColumn("_turn", turn)
    # Among the points themselves any order gives the same total.
    return (running_total(merged, keys, at, F.col("_open"), "_held", tie=["_turn"]).where("_open = 0")
            .withColumn("covered", (F.col("_held") > 0).cast("int")).drop("_open", "_turn", "_held"))
