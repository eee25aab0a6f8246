"""Matching flagged events to injected transits and to known times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit, wilson
from dipsift.operators.pairs import covered, nearest_gap
from dipsift.operators.skew import range_join


def recovery_labels(events: DataFrame, tests: DataFrame, test_key: Sequence[str],
                    spread: Sequence[str]) -> DataFrame:
    """Flagged events of each test labelled against its lead and partner: strictly
    closer than half the injected duration.  Every event is kept."""
    cols = ["inj_time", "inj_duration", "partner_time"]
    # Tests are unique on the key and as many as events: a plain join, no copies.
    df = events.join(tests.select(*test_key, *cols), list(test_key))
    half = F.col("inj_duration") / lit(2)
    lead = F.abs(F.col("event_time") - F.col("inj_time")) < half
    partner = F.coalesce(F.abs(F.col("event_time") - F.col("partner_time")) < half, F.lit(False))
    paired = F.col("partner_time").isNotNull()
    return (df.withColumn("is_lead", lead.cast("int")).withColumn("is_partner", partner.cast("int"))
            .withColumn("label", (lead | partner).cast("int"))
            .withColumn("pair_role", F.when(lead & paired, "lead").when(partner, "partner").otherwise("none"))
            .drop(*cols))


def recovery_by_test(tests: DataFrame, labelled: DataFrame, test_key: Sequence[str]) -> DataFrame:
    found = labelled.groupBy(*test_key).agg(
        F.max("is_lead").alias("recovered"), F.max("is_partner").alias("recovered_partner"),
        F.count(F.lit(1)).alias("n_events_flagged"))
    out = tests.join(found, list(test_key), "left").fillna(
        0, ["recovered", "recovered_partner", "n_events_flagged"])
    return out.withColumn("recovered_pair", F.col("recovered") * F.col("recovered_partner"))


def first_listed_transit(events: DataFrame, transits: DataFrame, key: Sequence[str],
                         spread: Sequence[str], event_key: str, order: str) -> DataFrame:
    """Each event with the first transit, in list order, closer than half of its
    duration (floored at two cadences); NULL when none.

    ``transits``: key, t_transit, transit_duration, ``order`` (list position)."""
    half = F.greatest(F.col("transit_duration"), lit(2 * k.CADENCE_DAYS)) / lit(2)
    t = transits.withColumns({"_half": half, "_mlo": F.col("t_transit") - half,
                              "_mhi": F.col("t_transit") + half})
    pairs = (range_join(events, t, key, "event_time", "_mlo", "_mhi", 1.0, spread)
             .where(F.abs(F.col("event_time") - F.col("t_transit")) < F.col("_half")))
    first = pairs.groupBy(*key, event_key).agg(F.min(F.struct(order, "t_transit")).alias("_m"))
    return (events.join(first, [*key, event_key], "left")
            .withColumn(order, F.col(f"_m.{order}")).withColumn("t_transit", F.col("_m.t_transit"))
            .drop("_m").withColumn("label", F.col(order).isNotNull().cast("int")))


def matched_to_known(events: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags events that lie within ``max(duration / 2, t_unc)`` of a known time
    of their system, and known times so matched (closed bounds).

    Both sides are answered by sorted lookups (nearest neighbour, or coverage by
    the other side's intervals), so dense systems form no event x time pairs.
    ``events``: tic, event_time, duration; ``known``: tic, t_known, t_unc."""
    ev = events.withColumn("_at", F.col("event_time"))
    kn = known.withColumn("_at", F.col("t_known"))
    own_e = F.col("duration") / lit(2)
    own_k = F.col("t_unc")

    def flag(points: DataFrame, own: Column, others: DataFrame, reach: Column) -> DataFrame:
        cover = others.select("tic", (F.col("_at") - reach).alias("_a"), (F.col("_at") + reach).alias("_z"))
        hit = covered(points, cover, ["tic"], "_at", "_a", "_z", closed=True)
        hit = nearest_gap(others, hit, ["tic"], "_at", "_gap")
        near = F.coalesce(F.col("_gap") <= own, F.lit(False)) | (F.col("covered") == 1)
        return hit.withColumn("matched", near.cast("int")).drop("_at", "_gap", "covered")

    return flag(ev, own_e, kn, own_k), flag(kn, own_k, ev, own_e)


def recovers_reference(events: DataFrame, known: DataFrame, min_tolerance: float = 0.15,
                       min_snr: float = 8.0) -> DataFrame:
    """Known times with at least one event of ``snr >= min_snr`` strictly closer
    than ``max(min_tolerance, duration / 2)``."""
    tol = F.greatest(lit(min_tolerance), F.col("duration") / lit(2))
    strong = events.where(F.col("snr") >= lit(min_snr)).select(
        "tic", (F.col("event_time") - tol).alias("_a"), (F.col("event_time") + tol).alias("_z"))
    return covered(known, strong, ["tic"], "t_known", "_a", "_z").withColumnRenamed("covered", "recovered")


def with_wilson(df: DataFrame, successes: str, trials: str, z: float, clipped: bool,
                lo: str = "wilson_lo", hi: str = "wilson_hi") -> DataFrame:
    a, b = wilson(F.col(successes), F.col(trials), z, clipped)
    return df.withColumn(lo, a).withColumn(hi, b)


def mission_rollup(events: DataFrame, known: DataFrame, z: float = 1.96) -> DataFrame:
    """Matched events, passes and known times per mission with Wilson bounds;
    pools that are not planet hosts stay out.  A mission with only one of the two
    keeps its row, with zeros for the other."""
    e = events.where("kind = 'planet'").groupBy("mission").agg(
        F.sum("matched").alias("d1"),
        F.count_if((F.col("matched") == 1) & F.col("passed")).alias("n_pass"))
    t = known.where("kind = 'planet'").groupBy("mission").agg(F.count(F.lit(1)).alias("d2"))
    return with_wilson(e.join(t, "mission", "full").fillna(0, ["d1", "n_pass", "d2"]), "n_pass", "d1", z, clipped=True)
