"""Host-level tables: orbit columns, depth ratios, pair-host screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions import physics
from dipsift.functions.expr import clip, lit
from dipsift.operators.skew import attach


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in an explicit order (unlike ``dropDuplicates``).  The
    winner is found by a combinable minimum, so no key is gathered in one task;
    ``order`` must be a total order of sortable columns."""
    picked = [c if isinstance(c, Column) else F.col(c) for c in order]
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(picked)],
                          F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best._row.*").select(*df.columns)


def orbit_columns(host: DataFrame) -> DataFrame:
    """Adds ecc (0 when undetermined), p_crit, log10_pp_over_pbin and the
    same-star flag; every value is constant per system."""
    _, _, e = physics.eccentricity(F.col("prim_pos"), F.col("sec_pos"),
                                   F.col("prim_width"), F.col("sec_width"))
    out = host.withColumn("ecc", F.coalesce(e, lit(0)))
    out = out.withColumn("p_crit", physics.critical_period(F.col("period"), F.col("ecc")))
    return out.withColumns({
        "log10_pp_over_pbin": F.log10(F.col("p_crit") / F.col("period")),
        "same_star_multi_allowed": physics.same_star_multiple_allowed(F.col("p_crit"), F.col("period"))})


def campaign_depth_ratio(ratio: Column) -> Column:
    """Missing or non-positive ratios count as 1; clipped for injection."""
    return clip(F.when(ratio > 0, ratio).otherwise(lit(1)), 0.05, 1.0)


def host_table(host: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Orbit columns plus the measured eclipse depth ratio for injection
    (``depth_ratio``, defaulted) and for export (``depth_ratio_raw``, NULL if absent)."""
    out = orbit_columns(host)
    out = out.join(noise.select("tic", F.col("depth_ratio").alias("depth_ratio_raw")), "tic", "left") \
        if noise is not None else out.withColumn("depth_ratio_raw", F.lit(None).cast("double"))
    return out.withColumn("depth_ratio", campaign_depth_ratio(F.col("depth_ratio_raw")))


def lookup(events: DataFrame, host: DataFrame, spread: Sequence[str],
           key: str = "tic") -> DataFrame:
    """Host columns on events; ``host_found`` tells hits from misses."""
    return (attach(events, host.withColumn("_hit", F.lit(1)), [key], spread)
            .withColumn("host_found", F.coalesce("_hit", F.lit(0))).drop("_hit"))


def partner_snr(ratio: Column, rms: Column, reference_depth: float = k.REFERENCE_DEPTH) -> Column:
    return lit(reference_depth) * ratio / (rms / lit(k.CADENCES_PER_TRANSIT ** 0.5))


def pair_host_screen(noise: DataFrame, ratio_min: float = k.SCREEN_RATIO,
                     snr_min: float = k.SCREEN_SNR) -> DataFrame:
    """Hosts whose shallower partner transit would clear the measured noise."""
    return (noise.where(F.col("depth_ratio").isNotNull() & F.col("rms_cadence").isNotNull())
            .withColumn("partner_depth", lit(k.REFERENCE_DEPTH) * F.col("depth_ratio"))
            .withColumn("partner_snr", partner_snr(F.col("depth_ratio"), F.col("rms_cadence")))
            .where((F.col("depth_ratio") >= lit(ratio_min)) & (F.col("partner_snr") >= lit(snr_min))))


def screen_grid(noise: DataFrame, depths: Sequence[float], snrs: Sequence[float]) -> DataFrame:
    """Counts of detectable / physical / strong hosts on a grid of thresholds, in
    one pass: the grid is an array literal, not a joined table."""
    grid = F.array(*[F.struct(lit(d).alias("ref_depth"), lit(s).alias("snr_min"))
                     for d in depths for s in snrs])
    rows = (noise.where(F.col("depth_ratio").isNotNull())
            .select("depth_ratio", "rms_cadence", "prim_depth", F.explode(grid).alias("g")))
    det = (F.col("depth_ratio") * F.col("g.ref_depth")
           / (F.col("rms_cadence") / lit(k.CADENCES_PER_TRANSIT ** 0.5)) >= F.col("g.snr_min"))
    phys = det & (F.col("depth_ratio") >= lit(k.SCREEN_RATIO))
    strong = phys & (F.col("prim_depth") >= lit(0.30))
    return rows.groupBy(F.col("g.ref_depth").alias("ref_depth"), F.col("g.snr_min").alias("snr_min")).agg(
        F.count_if(det).alias("n_detectable"), F.count_if(phys).alias("n_physical"),
        F.count_if(strong).alias("n_strong"))


def ranked_pair_hosts(noise: DataFrame, files: DataFrame, n_hosts: int, min_files: int = 2,
                      snr_min: float = k.SCREEN_SNR) -> DataFrame:
    """Best hosts by partner SNR among those with enough observed files."""
    return (pair_host_screen(noise, snr_min=snr_min).join(files, "tic").where(F.col("n_files") >= min_files)
            .orderBy(F.desc("partner_snr"), "tic").limit(n_hosts))


def sector_pairs(host: DataFrame) -> DataFrame:
    """Explodes a delimited sector list into distinct (tic, sector); blanks and
    unparseable tokens vanish, "7.0" reads as 7."""
    return (host.select("tic", F.explode(F.split(F.regexp_replace("sectors", ";", ","), ",")).alias("_t"))
            .withColumn("_t", F.trim("_t"))
            .select("tic", F.expr("cast(try_cast(_t as double) as bigint)").alias("sector"))
            .where(F.col("sector").isNotNull()).distinct())


def reconcile(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys with a ``present`` flag."""
    have = present.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return (expected.join(have, list(keys), "left")
            .withColumn("present", F.coalesce("_hit", F.lit(0))).drop("_hit"))


def sector_order(df: DataFrame) -> Window:
    return Window.partitionBy("tic").orderBy("sector")
