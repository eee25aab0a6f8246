"""Cleaning of observations: crowding, finite rows, rebinning, inversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import finite, fold, in_eclipse, lit
from dipsift.operators.ordered import with_neighbours
from dipsift.operators.rank import quantiles
from dipsift.operators.skew import attach

CURVE = ["tic", "sector"]


def crowding_corrected(lc: DataFrame, crowd: Column, fraction: Column) -> DataFrame:
    """Removes contaminating flux and normalises each curve to median 1.

    The correction is affine with positive slope, so the corrected median follows
    from the raw one and a single order statistic per curve is enough.  Zero flux
    counts as missing."""
    raw = lc.withColumn("flux", F.when(F.col("flux") != 0, F.col("flux")))
    med = quantiles(raw, CURVE, "flux", {"_med": 0.5}).drop("n")
    out = attach(raw, med, CURVE, ["time"])
    corrected = (F.col("flux") - (lit(1) - crowd) * F.col("_med")) / fraction
    level = (F.col("_med") - (lit(1) - crowd) * F.col("_med")) / fraction
    return (out.withColumn("flux_err", F.col("flux_err") / fraction / level)
               .withColumn("flux", corrected / level).drop("_med"))


def finite_rows(lc: DataFrame, columns: Sequence[str] = ("time", "flux", "flux_err", "phase")) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(F.col(c))
    return lc.where(keep)


def long_cadence(lc: DataFrame, cadence: float = k.CADENCE_DAYS) -> DataFrame:
    """Averages curves whose median spacing is below ``cadence`` into cadence
    bins; other curves pass unchanged.  Returns tic, sector, time, flux, flux_err."""
    cols = [*CURVE, "time", "flux", "flux_err"]
    spaced = (with_neighbours(lc.select(*cols), CURVE, "time")
              .withColumn("_step", F.col("time") - F.col("_prev.time")))
    pace = quantiles(spaced, CURVE, "_step", {"_pace": 0.5}).drop("n")
    rows = attach(lc.select(*cols), pace, CURVE, ["time"])
    fine = F.col("_pace") < lit(cadence)
    binned = (rows.where(fine)
              .groupBy(*CURVE, F.floor(F.col("time") / lit(cadence)).alias("_bin"))
              .agg(F.avg("time").alias("time"), F.avg("flux").alias("flux"),
                   (F.sqrt(F.sum(F.col("flux_err") * F.col("flux_err"))) / F.count("flux")).alias("flux_err"))
              .select(*cols))
    return rows.where(~fine | F.col("_pace").isNull()).select(*cols).unionByName(binned)


def rephased(lc: DataFrame, host: DataFrame, spread: Sequence[str] = ("time",)) -> DataFrame:
    """Phase and eclipse mask of averaged cadences, from their own times; curves of
    unknown systems get neither.  ``host``: tic, period, bjd0, prim_*, sec_*."""
    at = fold(F.col("time"), F.col("bjd0"), F.col("period"))
    known = ["tic", "period", "bjd0", "prim_pos", "prim_width", "sec_pos", "sec_width"]
    rows = attach(lc, host.select(*known), ["tic"], spread).withColumn("phase", at)
    inside = in_eclipse(F.col("phase"), (F.col("prim_pos"), F.col("prim_width")), (F.col("sec_pos"), F.col("sec_width")))
    return rows.withColumn("ecl_mask", F.when(F.col("phase").isNotNull(), inside.cast("int"))).drop(*known[1:])


def inverted(flux: Column, flag: Column) -> Column:
    """Turns dips into bumps on flagged rows: ``((f - 1) * -1) + 1``."""
    return F.when(flag == 1, (flux - lit(1)) * lit(-1) + lit(1)).otherwise(flux)


def real_crossings(crossings: DataFrame) -> DataFrame:
    """Drops records that are no disc crossing: grazing misses, zero durations,
    and the two stars themselves."""
    return crossings.where((F.abs("impact") < lit(k.IMPACT_MAX))
                           & (F.col("egress") - F.col("ingress") >= lit(k.CROSSING_MIN_DAYS))
                           & (F.col("body") >= 3))


def ephemeris_match(time: Column, period: Column, primary: Column, secondary: Column,
                    tolerance: float = 0.3) -> dict[str, Column]:
    """Distance to the nearest predicted epoch of both series, the class it
    implies (ties go to the primary) and the primary timing residual in minutes."""
    def nearest(t0: Column) -> Column:
        return t0 + F.rint((time - t0) / period) * period
    d1, d2 = F.abs(time - nearest(primary)), F.abs(time - nearest(secondary))
    kind = (F.when((d1 < lit(tolerance)) & (d1 <= d2), "primary")
             .when((d2 < lit(tolerance)) & (d2 < d1), "secondary").otherwise("neither"))
    return {"d_primary": d1, "d_secondary": d2, "kind": kind,
            "residual_min": F.when(kind == "primary", (time - nearest(primary)) * lit(1440))}
