"""Conjunction census: crossing depths, pair geometry, rates and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit
from dipsift.operators.clean import real_crossings
from dipsift.operators.pairs import crossing_pairs
from dipsift.operators.rank import interpolated, ks_two_sample, order_statistics, quantiles, scalar
from dipsift.operators.skew import range_join


def crossing_depths(lc: DataFrame, crossings: DataFrame, min_inside: int = 2, min_near: int = 5) -> DataFrame:
    """Depth of each crossing against the median flux one to three durations
    away; crossings with thin data or star-like depths drop out."""
    c = (crossings.select(F.col("model").alias("tic"), "event_id", F.col("time").alias("t_cross"),
                          F.greatest(F.col("egress") - F.col("ingress"), lit(1e-3)).alias("_dur"))
         .withColumns({"_a": F.col("t_cross") - lit(3) * F.col("_dur") - lit(1e-9),
                       "_z": F.col("t_cross") + lit(3) * F.col("_dur") + lit(1e-9)}))
    off = F.abs(F.col("time") - F.col("t_cross"))
    p = (range_join(lc.select("tic", "time", "flux"), c, ["tic"], "time", "_a", "_z", 1.0, ["time"])
         .where(off <= lit(3) * F.col("_dur")))
    inside = F.when(off <= F.col("_dur") / lit(2), F.col("flux"))
    near = F.when(off > F.col("_dur"), F.col("flux"))
    depth = lit(1) - F.col("_lo") / F.col("_cont")
    return (p.groupBy("tic", "event_id")
            .agg(F.count(inside).alias("_ni"), F.min(inside).alias("_lo"),
                 F.count(near).alias("_nn"), F.median(near).alias("_cont"))
            .where((F.col("_ni") >= min_inside) & (F.col("_nn") >= min_near) & (F.col("_cont") > 0))
            .select("tic", "event_id", depth.alias("crossing_depth"))
            .where((F.col("crossing_depth") > 0) & (F.col("crossing_depth") <= lit(k.MAX_PLANET_DEPTH))))


def conjunctions(crossings: DataFrame) -> DataFrame:
    return crossing_pairs(real_crossings(crossings), ["model", "cycle"])


def census_rates(conj: DataFrame, by: str = "sigma_bin") -> DataFrame:
    """Pair and same-star-multiple rates, per ``by`` and in total (NULL)."""
    return conj.rollup(by).agg(F.count(F.lit(1)).alias("n_conjunctions"),
                               F.avg("is_pair").alias("pair_rate"),
                               F.avg("same_star_multiple").alias("same_star_rate"))


def detected_pair_rate(tests: DataFrame, key: list[str]) -> DataFrame:
    """Among conjunctions with both stars crossed, the share with both recovered."""
    g = tests.groupBy(*key).agg(F.countDistinct("star").alias("_n"),
                                F.countDistinct(F.when(F.col("recovered") == 1, F.col("star"))).alias("_r"))
    both = F.col("_n") >= 2
    return g.agg(F.count_if(both).alias("n_geometric"), F.count_if(both & (F.col("_r") >= 2)).alias("n_detected")) \
        .withColumn("detected_pair_rate", F.col("n_detected") / F.greatest(F.col("n_geometric"), F.lit(1)))


def quantile_fit(values: DataFrame, column: str, n: int = 40) -> DataFrame:
    """Winsorises at the 99th percentile, then ``n`` mid-quantiles as
    (position, prob, quantile) rows with the cap and the number capped.  Capping
    keeps the order, so one set of order statistics serves both steps."""
    good = values.where(F.col(column) > 0).select(column)
    mids = [(0.5 + i) / n for i in range(n)]
    stats = (order_statistics(good, [], column, [0.99, *mids])
             .withColumn("cap", interpolated(0.99)).select("n", "_at", "cap"))
    cells = F.array(*[F.struct(F.lit(i).alias("position"), lit(p).alias("prob")) for i, p in enumerate(mids)])
    cap = scalar(stats, F.col("cap"))
    hit = good.agg(F.count_if(F.col(column) > cap).alias("_h"))
    return (stats.withColumn("c", F.explode(cells))
            .select("c.position", "c.prob", interpolated(F.col("c.prob"), F.col("cap")).alias("quantile"),
                    F.col("n").alias("n_values"), scalar(hit, F.col("_h")).alias("n_capped"), "cap"))


def distribution_shift(df: DataFrame, value: str, is_observed, p_trip: float = k.CENSUS_KS_P,
                       median_trip: float = k.CENSUS_SPACING_TRIP) -> DataFrame:
    """Observed against reference sample: KS statistic and p, relative median
    offset, and whether both thresholds trip."""
    d = df.withColumn("_o", is_observed)
    med = quantiles(d, ["_o"], value, {"m": 0.5})
    pair = scalar(med.agg(F.max(F.when(F.col("_o"), F.col("m"))).alias("a"),
                          F.max(F.when(~F.col("_o"), F.col("m"))).alias("b")), F.struct("a", "b"))
    a, b = pair.getField("a"), pair.getField("b")
    return (ks_two_sample(d, [], value, F.col("_o"))
            .withColumn("median_first", a).withColumn("median_second", b)
            .withColumn("median_offset", F.abs(a - b) / F.greatest(b, lit(1e-9)))
            .withColumn("tripped", ((F.col("p_value") < lit(p_trip)) & (F.col("median_offset") > lit(median_trip))).cast("int")))


