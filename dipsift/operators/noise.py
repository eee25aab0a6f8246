"""Per-system noise of observation series after local detrending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit, outside_widened
from dipsift.operators.lineage import materialise
from dipsift.operators.ordered import islands
from dipsift.operators.rank import median_mad, quantiles
from dipsift.operators.skew import attach

CURVE = ["tic", "sector"]
CHUNK = [*CURVE, "chunk"]
# Normalised flux; places buckets only, values outside still count exactly.


def quadratic_residuals(rows: DataFrame, min_chunk: int) -> DataFrame:
    """Residuals of a least-squares parabola per chunk, from power sums alone
    (combinable on the map side) and a closed 3x3 solution."""
    # One time origin per chunk keeps the power sums small.
    origin = rows.groupBy(*CHUNK).agg(F.avg("time").alias("_t0"), F.count("time").alias("_nc")) \
        .where(F.col("_nc") >= min_chunk)
    x = F.col("_x")
    pts = attach(rows, origin, CHUNK, ["time"], "inner").withColumn("_x", F.col("time") - F.col("_t0"))
    y = F.col("flux")
    sums = pts.groupBy(*CHUNK).agg(
        F.count(x).cast("double").alias("s0"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"),
        F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"),
        F.sum(y).alias("y0"), F.sum(x * y).alias("y1"), F.sum(x * x * y).alias("y2"))
    c = {n: F.col(n) for n in ("s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2")}
    s0, s1, s2, s3, s4, y0, y1, y2 = c.values()
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    coef = (sums.withColumn("_det", det).where(F.col("_det") > lit(1e-9))
            .select(*CHUNK,
                    ((y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / F.col("_det")).alias("c0"),
                    ((s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / F.col("_det")).alias("c1"),
                    ((s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / F.col("_det")).alias("c2")))
    fit = F.col("c0") + F.col("c1") * x + F.col("c2") * x * x
    return (attach(pts, coef, CHUNK, ["time"], "inner")
            .withColumn("residual", y - fit).drop("_x", "_t0", "_nc", "c0", "c1", "c2"))


def noise_screen(lc: DataFrame, host: DataFrame, min_points: int = k.NOISE_MIN_POINTS,
                 min_chunk: int = k.NOISE_MIN_CHUNK) -> DataFrame:
    """Median per-cadence noise over the files of a system, with the eclipse depth
    ratio (fallback depth columns ``*_alt`` are used where the main ones are NULL)."""
    ecl = host.select("tic", "prim_pos", "prim_width", "sec_pos", "sec_width")
    rows = (attach(lc.select(*CURVE, "time", "flux", "phase"), ecl, ["tic"], ["time"], "inner")
            .where(outside_widened(F.col("phase"), (F.col("prim_pos"), F.col("prim_width")),
                                   (F.col("sec_pos"), F.col("sec_width"))))
            .select(*CURVE, "time", "flux"))
    level = (quantiles(rows, CURVE, "flux", {"_level": 0.5})
             .where((F.col("n") >= min_points) & (F.col("_level") > 0)).drop("n"))
    kept = materialise(attach(rows, level, CURVE, ["time"], "inner"), "out-of-eclipse")
    chunked = islands(kept, CURVE, "time", k.CHUNK_BREAK_DAYS, "chunk")
    res = (quadratic_residuals(chunked, min_chunk)
           .select(*CURVE, "time", (F.col("residual") / F.col("_level")).alias("res")))
    res = materialise(res, "residuals")
    per_file = median_mad(res, CURVE, "res", ["time"]).select(
        *CURVE, (lit(k.MAD_TO_SIGMA) * F.col("mad")).alias("rms"))
    systems = per_file.groupBy("tic").agg(F.count("rms").alias("n_files"), F.median("rms").alias("rms_cadence"))

    def depth(which: str):
        alt = f"{which}_depth_alt"
        main = F.col(f"{which}_depth")
        return F.coalesce(main, F.col(alt)) if alt in host.columns else main

    depths = host.select("tic", depth("prim").alias("prim_depth"), depth("sec").alias("sec_depth"), "prim_pos", "sec_pos")
    ratio = F.when((F.col("prim_depth") > 0) & (F.col("sec_depth") != 0), F.col("sec_depth") / F.col("prim_depth"))
    return systems.join(depths, "tic").withColumn("depth_ratio", ratio)
