"""Joins that stay balanced when one key holds a large share of the rows.

``attach`` puts a per-key table onto a row table; ``range_join`` matches points
to intervals under an equality key.  Both spread the row side over ``salts``
sub-keys by a deterministic hash and replicate the (small) other side once per
salt, so a hot key becomes ``salts`` tasks.  ``centred_join`` and ``arc_join`` copy the
points instead: all pairs of an interval meet in one place, so that what is grouped by
interval afterwards is not shuffled.  A side under the session's
broadcast threshold is still broadcast by the planner; nothing is hinted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions.expr import lit

SALTS = 8
RING = 4096
TOGETHER = 1024  # arcs of one key that share a copy of its points


def salt_of(spread: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts))


def all_salts(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str],
           spread: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a table that is unique on ``keys`` onto skewed rows.

    ``spread`` names row columns (identity or time) whose hash spreads one key's
    rows; only ``left`` and ``inner`` make sense for a replicated right side."""
    if how not in ("left", "inner"):
        raise ValueError("attach replicates the table side: left or inner only")
    left = rows.withColumn("_salt", salt_of(spread, salts))
    right = table.withColumn("_salt", all_salts(salts))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str,
               lo: str, hi: str, bucket: float, spread: Sequence[str],
               salts: int = SALTS) -> DataFrame:
    """All (point, interval) pairs with ``lo <= at <= hi`` under equal ``keys``.

    Points sit in one bucket; intervals are copied to the buckets they touch, so
    each pair appears exactly once and only neighbours in ``at`` ever meet.
    Column names of the two sides must differ apart from ``keys``."""
    p = (points.withColumn("_b", F.floor(F.col(at) / lit(bucket)))
               .withColumn("_salt", salt_of(spread, salts)))
    i = (intervals
         .where(F.col(lo) <= F.col(hi))
         .withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / lit(bucket)),
                                                F.floor(F.col(hi) / lit(bucket)))))
         .withColumn("_salt", all_salts(salts)))
    return (p.join(i, [*keys, "_b", "_salt"])
             .where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))
             .drop("_b", "_salt"))


def ring_join(points: DataFrame, arcs: DataFrame, keys: Sequence[str], phase: str,
              centre: str, half: str, spread: Sequence[str],
              salts: int = SALTS, finest: int = RING) -> DataFrame:
    """Candidate (point, arc) pairs on the unit circle: equal ``keys`` and the
    point's ring slot among the slots the arc touches.  The caller applies its own
    residual predicate; each pair appears once.

    Every key has a ring of its own, with slots as wide as its widest arc (at most
    ``finest`` slots), so an arc touches three slots at most and few points beside it."""
    rings = arcs.groupBy(*keys).agg(F.greatest(F.lit(1), F.least(F.lit(finest), F.floor(
        lit(1) / F.greatest(lit(2) * F.max(half), lit(1e-12))))).cast("bigint").alias("_ring"))
    ring = F.col("_ring")
    slots = F.when(
        F.col(half) * lit(2) + lit(2.0) / ring >= lit(1.0), F.sequence(F.lit(0).cast("bigint"), ring - 1),
    ).otherwise(F.transform(
        F.sequence(F.floor((F.col(centre) - F.col(half)) * ring), F.floor((F.col(centre) + F.col(half)) * ring)),
        lambda s: F.pmod(s, ring)))
    p = (attach(points, rings, keys, spread, "inner", salts)
         .withColumn("_b", F.pmod(F.floor(F.col(phase) * ring), ring))
         .withColumn("_salt", salt_of(spread, salts)).drop("_ring"))
    a = (arcs.join(rings, list(keys)).withColumn("_b", F.explode(slots))
         .withColumn("_salt", all_salts(salts)).drop("_ring"))
    return p.join(a, [*keys, "_b", "_salt"]).drop("_b", "_salt")


def centred_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, centre: str, half: str,
                 width: float = 2.0) -> DataFrame:
    """All (point, interval) pairs with ``|at - centre| <= half`` under equal ``keys``, with the
    ``_shard`` that holds every pair of an interval: grouping by (keys, _shard, interval) moves no pair.

    An interval lies in the shard of its centre, points are copied to the shards they can be seen
    from.  Shards are twice as wide as the widest interval reaches, or ``width`` if that is more, so
    a point has two copies at most on average."""
    reach = intervals.select(F.max(half) + lit(1e-6)).scalar()
    p = points.withColumn("_reach", reach).withColumn("_wide", F.greatest(lit(width), lit(2) * F.col("_reach")))
    p = p.withColumn("_shard", F.explode(F.sequence(F.floor((F.col(at) - F.col("_reach")) / F.col("_wide")),
                                                    F.floor((F.col(at) + F.col("_reach")) / F.col("_wide"))))).drop("_reach", "_wide")
    i = intervals.withColumn("_shard", F.floor(F.col(centre) / F.greatest(lit(width), lit(2) * reach)))
    return p.join(i, [*keys, "_shard"]).where(F.abs(F.col(at) - F.col(centre)) <= F.col(half))


def arc_join(points: DataFrame, arcs: DataFrame, keys: Sequence[str], phase: str, centre: str, half: str,
             spread: Sequence[str], salts: int = SALTS, finest: int = RING, together: int = TOGETHER) -> DataFrame:
    """As :func:`ring_join`, but all pairs of an arc meet in one (keys, ``_slot``, ``_way``): grouping by
    these and the arc moves no pair.

    Slots are as wide as the widest arc of the key, so a point has at most three copies.  The arcs of a
    key with more than ``together`` of them go several ways, with a copy of its points each."""
    rings = arcs.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.least(F.lit(finest), F.floor(lit(1) / F.greatest(lit(2) * F.max(half), lit(1e-12))))).cast("bigint").alias("_ring"),
        F.max(half).alias("_reach"), F.ceil(F.count(F.lit(1)) / F.lit(together)).cast("bigint").alias("_ways"))
    ring, none = F.col("_ring"), F.lit(0).cast("bigint")
    seen = F.array_distinct(F.transform(
        F.sequence(F.floor((F.col(phase) - F.col("_reach")) * ring), F.floor((F.col(phase) + F.col("_reach")) * ring)),
        lambda s: F.pmod(s, ring)))
    p = (attach(points, rings, keys, spread, "inner", salts)
         .withColumn("_slot", F.explode(F.when(ring == 1, F.array(none)).otherwise(seen)))
         .withColumn("_way", F.explode(F.sequence(none, F.col("_ways") - 1))).drop("_ring", "_reach", "_ways"))
    a = (arcs.join(rings, list(keys)).withColumn("_slot", F.pmod(F.floor(F.col(centre) * ring), ring))
         .withColumn("_way", F.pmod(F.xxhash64(centre, half), F.col("_ways"))).drop("_ring", "_reach", "_ways"))
    return p.join(a, [*keys, "_slot", "_way"])
