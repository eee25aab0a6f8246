"""Keyed-hash sampling: class rebalancing, subsamples, empirical draws, designs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import clip, lit, normal, pair_window, uniform
from dipsift.operators.ordered import locate
from dipsift.operators.rank import cumulative, scalar
from dipsift.operators.skew import attach


def keep_lowest(df: DataFrame, keys: Sequence[str], u: str, quota: DataFrame, spread: Sequence[str],
                name: str = "keep") -> DataFrame:
    """Adds ``name`` = 1 on the ``quota.k`` rows of each key with the lowest ``u``
    (all rows where the key has no quota).  The cut value comes from cumulative
    counts, so no key is sorted in one task."""
    c = cumulative(df, keys, u, {"_c": F.lit(1)})
    cut = (c.join(quota, list(keys)).groupBy(*keys)
           .agg(F.max(F.when(F.col("_c_below") < F.col("k"), F.col(u))).alias("_cut"), F.lit(1).alias("_has")))
    return (attach(df, cut, keys, spread)
            .withColumn(name, F.when(F.col("_has").isNull() | (F.col(u) <= F.col("_cut")), 1).otherwise(0))
            .drop("_cut", "_has"))


def rebalance(df: DataFrame, seed: str, row_key: str, strata: Sequence[str] = (), label: str = "label",
              arm: str = "inverted") -> DataFrame:
    """Flags rows so that the negatives' share of ``arm`` matches the positives':
    within each stratum of the negatives the over-represented arm is thinned, one
    arm only; a stratum with an empty arm is left as it is.  NULL is a stratum
    like any other."""
    df = df.withColumn("_stratum", F.to_json(F.struct(*strata)) if strata else F.lit(""))
    rate = scalar(df, F.avg(F.when(F.col(label) == 1, F.col(arm))))
    neg = df.where(F.col(label) == 0)
    n = neg.groupBy("_stratum").agg(F.sum(arm).alias("_inv"), F.count_if(F.col(arm) == 0).alias("_nat")) \
        .withColumn("_t", rate).where((F.col("_inv") > 0) & (F.col("_nat") > 0) & F.col("_t").isNotNull())
    inv, nat, t = F.col("_inv"), F.col("_nat"), F.col("_t")
    inv_max = F.when(t < lit(1), F.floor(nat * t / (lit(1) - t))).otherwise(inv)
    nat_max = F.when(t > lit(0), F.floor(inv * (lit(1) - t) / t)).otherwise(nat)
    quota = n.select("_stratum", F.when(inv > inv_max, F.struct(F.lit(1).alias(arm), inv_max.alias("k")))
                     .when(nat > nat_max, F.struct(F.lit(0).alias(arm), nat_max.alias("k"))).alias("_q")) \
        .where(F.col("_q").isNotNull()).select("_stratum", "_q.*")
    rows = df.withColumn("_u", uniform(seed, F.col(row_key)))
    kept = keep_lowest(rows.where(F.col(label) == 0), ["_stratum", arm], "_u", quota, [row_key], "rebalance_keep")
    return (rows.where(F.col(label) == 1).withColumn("rebalance_keep", F.lit(1))
            .unionByName(kept).drop("_u", "_stratum"))


def rebalance_report(flagged: DataFrame, label: str = "label", arm: str = "inverted") -> DataFrame:
    neg, kept = F.col(label) == 0, (F.col(label) == 0) & (F.col("rebalance_keep") == 1)
    a = F.col(arm)
    out = flagged.agg(F.avg(F.when(F.col(label) == 1, a)).alias("positive_rate"),
                      F.count_if(neg).alias("negatives_before"), F.count_if(kept).alias("negatives_after"),
                      F.avg(F.when(neg, a)).alias("rate_before"), F.avg(F.when(kept, a)).alias("rate_after"))
    return out.withColumns({"gap_before": F.abs(F.col("positive_rate") - F.col("rate_before")),
                            "gap_after": F.abs(F.col("positive_rate") - F.col("rate_after"))})


def even_mix(df: DataFrame, seed: str, row_key: str, arm: str) -> DataFrame:
    """Thins the larger arm to the size of the smaller one."""
    n = df.groupBy(arm).agg(F.count(F.lit(1)).alias("k"))
    low = scalar(n, F.min("k"))
    quota = n.select(arm, low.alias("k"))
    rows = df.withColumn("_u", uniform(seed, F.col(row_key)))
    return keep_lowest(rows, [arm], "_u", quota, [row_key]).where("keep = 1").drop("_u", "keep")


def cap_positives(df: DataFrame, seed: str, row_key: str, label: str = "label",
                  ratio: float = k.POSITIVES_PER_NEGATIVE) -> DataFrame:
    """At most ``ratio`` positives per negative."""
    n_neg = scalar(df, F.count_if(F.col(label) == 0))
    quota = df.where(F.col(label) == 1).groupBy(label).agg(F.lit(1).alias("_one")) \
        .select(label, F.floor(lit(ratio) * n_neg).alias("k"))
    rows = df.withColumn("_u", uniform(seed, F.col(row_key)))
    return keep_lowest(rows, [label], "_u", quota, [row_key]).where("keep = 1").drop("_u", "keep")


# --- empirical draws ---------------------------------------------------------

def _choose(options: Sequence[float], u: Column) -> Column:
    return F.element_at(F.array(*[lit(o) for o in options]), (F.floor(u * lit(len(options))) + 1).cast("int"))


def with_spacing_ratio(df: DataFrame, seed: str, key: str) -> DataFrame:
    """Adds ``spacing_ratio``: an observed spacing / period ratio, weighted by a
    Gaussian kernel in log10(p_planet / period), with a small jitter."""
    log_ratio = F.log10(F.col("p_planet") / F.col("period"))
    xs = [math.log10(pp / pb) for pb, pp, _ in k.OBSERVED_SPACINGS]
    table = F.array(*[F.struct(lit(x).alias("x"), lit(s / pb).alias("r"))
                      for x, (pb, _, s) in zip(xs, k.OBSERVED_SPACINGS)])
    weighed = F.transform(table, lambda o: F.struct(
        F.exp(lit(-0.5) * F.pow((o.getField("x") - F.col("_lx")) / lit(k.SPACING_KERNEL_DEX), lit(2))).alias("w"),
        o.getField("r").alias("r")))
    total = F.aggregate("_w", lit(0), lambda acc, o: acc + o.getField("w"))

    def walk(acc, o):
        run = acc.getField("run") + F.when(F.col("_tw") > 0, o.getField("w")).otherwise(lit(1))
        hit = F.coalesce(acc.getField("r"), F.when(F.col("_target") < run, o.getField("r")))
        return F.struct(run.alias("run"), hit.alias("r"))

    start = F.struct(lit(0).alias("run"), F.lit(None).cast("double").alias("r"))
    last = k.OBSERVED_SPACINGS[-1]
    mass = F.when(F.col("_tw") > 0, F.col("_tw")).otherwise(lit(len(xs)))
    return (df.withColumn("_lx", log_ratio).withColumn("_w", weighed).withColumn("_tw", total)
            .withColumn("_target", uniform(seed + ".row", F.col(key)) * mass)
            .withColumn("spacing_ratio", F.coalesce(F.aggregate("_w", start, walk).getField("r"), lit(last[2] / last[0]))
                        * F.exp(lit(k.SPACING_JITTER) * normal(seed + ".jit", F.col(key))))
            .drop("_lx", "_w", "_tw", "_target"))


def with_partner_draws(df: DataFrame, seed: str, key: str, duration: str, host_ratio: str) -> DataFrame:
    """Adds the partner's signed spacing (clipped into the pair window, NULL where
    the window is empty), depth ratio and duration ratio.  Needs ``period`` and
    ``p_planet``."""
    lo, hi = pair_window(F.col("period"), F.col(duration))
    dt = F.least(F.greatest(F.col("spacing_ratio") * F.col("period"), lo), hi)
    sign = F.when(uniform(seed + ".sign", F.col(key)) < lit(0.5), lit(-1)).otherwise(lit(1))
    return with_spacing_ratio(df, seed, key).withColumns({
        "partner_dt": F.when(hi > lo, dt * sign),
        "partner_ratio": depth_ratio(F.col(host_ratio), seed, F.col(key)),
        "partner_duration_ratio": duration_ratio(seed, F.col(key))}).drop("spacing_ratio")


def depth_ratio(host_ratio: Column, seed: str, *key: Column) -> Column:
    g = _choose(k.DEPTH_FACTOR_QUANTILES, uniform(seed + ".g", *key))
    return clip(host_ratio * g * F.exp(lit(k.DEPTH_RATIO_JITTER) * normal(seed + ".gj", *key)), *k.DEPTH_RATIO_CLIP)


def duration_ratio(seed: str, *key: Column) -> Column:
    q = _choose(k.DURATION_RATIO_QUANTILES, uniform(seed + ".q", *key))
    return clip(q * F.exp(lit(k.DURATION_RATIO_JITTER) * normal(seed + ".qj", *key)), *k.DURATION_RATIO_CLIP)


# --- parameter design --------------------------------------------------------

DESIGN_BASES = (2, 3, 5, 7, 11, 13)


def radical_inverse(index: Column, base: int) -> Column:
    """Low-discrepancy coordinate in [0, 1): the digits of ``index`` mirrored, as
    many as double precision holds."""
    out = lit(0)
    for j in range(math.ceil(53 / math.log2(base))):
        out = out + (F.floor(index / F.lit(base ** j)) % base) / lit(float(base) ** (j + 1))
    return out


def design_points(index: DataFrame, column: str) -> DataFrame:
    """Profile parameters for each index: log depth, duration, impact, limb
    darkening, and a time warp on the lowest share of the sixth axis."""
    u = [radical_inverse(F.col(column), b) for b in DESIGN_BASES]

    def between(x: Column, span) -> Column:
        return lit(span[0]) + x * lit(span[1] - span[0])

    depth = F.pow(lit(10), between(u[0], [math.log10(d) for d in k.DESIGN_DEPTH]))
    warp = F.when(u[5] < lit(k.DESIGN_WARP_FRACTION),
                  between(u[5] / lit(k.DESIGN_WARP_FRACTION), k.DESIGN_WARP)).otherwise(lit(0))
    return index.select(F.col(column), depth.alias("depth"), between(u[1], k.DESIGN_DURATION).alias("duration"),
                        between(u[2], k.DESIGN_IMPACT).alias("impact"), between(u[3], k.DESIGN_LIMB1).alias("u1"),
                        between(u[4], k.DESIGN_LIMB2).alias("u2"), warp.alias("warp"))


# --- cycle subsampling -------------------------------------------------------

def chosen_cycles(lc: DataFrame, events: DataFrame, n_star: Column, seed: str) -> DataFrame:
    """Orbit cycles to keep per event: its own, its local window, and ``n_star``
    hash-chosen others that hold cadences outside the local window.

    Cycles are intervals, counted by sorted lookups; event x cadence pairs are
    never formed.  ``events``: tic, event_id, event_time, duration, period.
    Returns (tic, event_id, cycle, lo, hi, n_cadences, kept), other cycles only."""
    from pyspark.sql import Window
    span = lc.groupBy("tic").agg(F.min("time").alias("_a"), F.max("time").alias("_z"))
    t, p = F.col("event_time"), F.col("period")
    half = F.greatest(lit(k.LOCAL_HALF_DURATIONS) * F.col("duration"), lit(k.LOCAL_HALF_MIN_DAYS))
    cyc = (attach(events, span, ["tic"], ["event_id"], "inner")
           .withColumn("cycle", F.explode(F.sequence(F.floor((F.col("_a") - t) / p + lit(0.5)),
                                                     F.floor((F.col("_z") - t) / p + lit(0.5)))))
           .where("cycle <> 0")
           .withColumns({"lo": t + (F.col("cycle") - lit(0.5)) * p, "hi": t + (F.col("cycle") + lit(0.5)) * p})
           # The local window may reach into neighbouring cycles; cut it off.
           .withColumn("lo", F.when(F.col("cycle") > 0, F.greatest(F.col("lo"), t + half)).otherwise(F.col("lo")))
           .withColumn("hi", F.when(F.col("cycle") < 0, F.least(F.col("hi"), t - half)).otherwise(F.col("hi")))
           .where(F.col("lo") < F.col("hi"))
           .select("tic", "event_id", "cycle", "lo", "hi", n_star.alias("_k")))
    ends = cyc.select("tic", "event_id", "cycle", "_k", F.explode(F.array("lo", "hi")).alias("time"), "lo", "hi")
    found = locate(lc.select("tic", "time"), ends, ["tic"], "time")
    counted = (found.groupBy("tic", "event_id", "cycle")
               .agg(F.max(F.when(F.col("time") == F.col("hi"), F.col("n_lt"))).alias("_h"),
                    F.max(F.when(F.col("time") == F.col("lo"), F.col("n_lt"))).alias("_l"),
                    F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("_k").alias("_k"))
               .withColumn("n_cadences", F.col("_h") - F.col("_l")).where("n_cadences > 0"))
    # Cycles of one event are bounded by baseline / period.
    w = Window.partitionBy("event_id").orderBy(uniform(seed, F.col("event_id"), F.col("cycle")), "cycle")
    return (counted.withColumn("kept", (F.row_number().over(w) <= F.col("_k")).cast("int"))
            .select("tic", "event_id", "cycle", "lo", "hi", "n_cadences", "kept"))


def cycle_caps(chosen: DataFrame, event_key: Sequence[str] = ("event_id",)) -> DataFrame:
    """:func:`chosen_cycles` as one row per event for :func:`views.fold_pairs`: the kept
    other cycles, no more than the event's budget."""
    return (chosen.where("kept = 1").groupBy(*event_key).agg(F.array_sort(F.collect_list("cycle")).alias("cycles")))
