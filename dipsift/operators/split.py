"""System tables and system-level splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit, uniform
from dipsift.operators.lineage import materialise
from dipsift.operators.rank import quantiles, ranked, scalar


def system_table(events: DataFrame, host: DataFrame) -> DataFrame:
    """One row per system: event mass, positives, coverage tier, terciles of period
    and magnitude over the systems present, and the combined stratum."""
    t = (events.groupBy("tic").agg(F.count(F.lit(1)).alias("n_events"), F.sum("label").alias("n_positive"),
                                   F.max("n_cycles_raw").alias("n_cycles"))
         .join(host.select("tic", "period", "tmag"), "tic", "left"))
    t = materialise(t, "systems")
    lo, hi = k.TIER_EDGES
    tier = F.when(F.col("n_cycles") < lo, "lt3").when(F.col("n_cycles") < hi, "3to9").otherwise("10plus")

    def tercile(c: str) -> Column:
        # Two numbers reach the driver, so that no subquery sits in an expression used many times.
        cut = quantiles(t, [], c, {"a": 1 / 3, "b": 2 / 3}).first()
        if cut is None or cut["n"] < 3:
            return F.lit("unknown")
        x = F.col(c)
        return F.when(x.isNull(), "unknown").when(x <= lit(cut["a"]), "lo").when(x <= lit(cut["b"]), "mid").otherwise("hi")

    return t.withColumns({"coverage": tier, "period_tercile": tercile("period"), "tmag_tercile": tercile("tmag")}) \
        .withColumn("stratum", F.concat_ws("|", "coverage", "period_tercile", "tmag_tercile"))


def stratified_split(systems: DataFrame, pinned_to_test: Sequence[int] = ()) -> DataFrame:
    """Assignment by event mass: the systems of a stratum, largest first, are dealt
    by the mirrored digits of their position, cut at the target shares.

    Neighbours in the order have nearly equal mass and any run of positions is
    spread evenly, so the shares of mass follow the targets, at any number of
    systems.  Pinned systems are test and carry no mass."""
    pinned = F.col("tic").isin([int(t) for t in pinned_to_test]) if pinned_to_test else F.lit(False)
    placed = ranked(systems.where(~pinned).select("tic", "stratum", "n_events"), "n_events", ["tic"], "_p", keys=["stratum"])
    placed = materialise(placed.select("tic", "stratum", "_p"), "placed")
    # The mirrored binary digits of the position, as a fraction.
    at = F.conv(F.reverse(F.lpad(F.bin(F.col("_p") - 1), 53, "0")), 2, 10).cast("double") / lit(2.0 ** 53)

    def cut(shares: Sequence[float]) -> Column:
        return F.when(at < lit(shares[0]), k.SPLITS[0]).when(at < lit(shares[0] + shares[1]), k.SPLITS[1]).otherwise(k.SPLITS[2])

    high = F.col("stratum").startswith("10plus")
    done = placed.select("tic", "stratum", F.when(high, cut(k.SPLIT_TARGETS_HIGH)).otherwise(cut(k.SPLIT_TARGETS)).alias("split"))
    return done.unionByName(systems.where(pinned).select("tic", "stratum", F.lit("test").alias("split")))


def group_split(systems: DataFrame, fraction: float, seed: str, key: str = "tic") -> DataFrame:
    """Holds out exactly ``ceil(fraction * n)`` whole systems by hash order."""
    u = systems.select(key).distinct().withColumn("_u", uniform(seed, F.col(key)))
    cut = cut_at(u, "_u", fraction)
    return u.select(key, (F.col("_u") <= cut).cast("int").alias("held_out"))


def cut_at(df: DataFrame, u: str, fraction: float) -> Column:
    """Largest value among the first ``ceil(fraction * n)`` of ``u``."""
    from dipsift.operators.rank import cumulative
    c = cumulative(df, [], u, {"c": F.lit(1)})
    k_rows = F.ceil(lit(fraction) * F.col("c_total"))
    return scalar(c, F.max(F.when(F.col("c_below") < k_rows, F.col(u))))


def split_violations(events: DataFrame, assignment: DataFrame, pinned_to_test: Sequence[int] = ()) -> DataFrame:
    """Rows (kind, tic) for every broken promise; empty when the split is sound."""
    twice = (assignment.groupBy("tic").agg(F.countDistinct("split").alias("n")).where("n > 1")
             .select(F.lit("system in two splits").alias("kind"), "tic"))
    moved = (assignment.where(F.col("tic").isin([int(t) for t in pinned_to_test] or [None]) & (F.col("split") != "test"))
             .select(F.lit("pinned system not in test").alias("kind"), "tic"))
    checked = events.select("tic", "split").distinct().join(
        assignment.select("tic", F.col("split").alias("_s")), "tic", "left")
    none = checked.where(F.col("split").isNull() | F.col("_s").isNull()).select(
        F.lit("events without a split").alias("kind"), "tic")
    off = checked.where(F.col("split") != F.col("_s")).select(F.lit("row disagrees with the map").alias("kind"), "tic")
    return twice.unionByName(moved).unionByName(none).unionByName(off)


def split_report(events: DataFrame, assignment: DataFrame) -> DataFrame:
    total = scalar(events, F.count(F.lit(1)))
    e = events.join(assignment.select("tic", "split"), "tic").groupBy("split").agg(
        F.countDistinct("tic").alias("n_systems"), F.count(F.lit(1)).alias("n_events"),
        F.sum("label").alias("n_positive"))
    return e.withColumn("event_fraction", F.col("n_events") / F.greatest(total, F.lit(1)))


def map_digest(assignment: DataFrame) -> DataFrame:
    """SHA-256 identity of the system -> split map, whatever its order: two sums of
    52-bit hashes of the lines and their count, digested."""
    line = F.md5(F.concat_ws(":", F.col("tic").cast("string"), F.col("split")))

    def total(start: int) -> Column:
        return F.sum(F.conv(F.substring(line, start, 13), 16, 10).cast("decimal(20,0)")).cast("string")

    return assignment.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(total(1), F.lit("0")),
                                             F.coalesce(total(14), F.lit("0"))), 256).alias("digest"))
