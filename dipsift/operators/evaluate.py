"""Evaluation: operating points, matched thresholds, bootstrap, completeness,
mission rollups, queue summaries, expected yield."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions import physics
from dipsift.functions.expr import (bin_of, bin_of_edges, clip, in_stratum, lit, normal,
                                    operating_point, uniform, wilson)
from dipsift.operators.lineage import materialise
from dipsift.operators.rank import cumulative, quantiles, scalar

SCOPES = ("pooled", "stratum")
POINTS = ("A", "B")


def flagged(test: DataFrame) -> DataFrame:
    """Row flags of the test split: positive, in stratum, real negative, admitted."""
    points = {f"op_{p}": operating_point(p, duration="t_dur") for p in POINTS}
    return test.withColumns({
        "pooled": F.col("label") == 1,
        "stratum": (F.col("label") == 1) & in_stratum(F.col("depth")),
        "real_neg": (F.col("label") == 0) & (F.col("label_source") == 0), **points})


def test_rows(record: DataFrame) -> DataFrame:
    return record.where((F.col("rebalance_keep") == 1) & (F.col("split") == "test"))


def incumbent_points(record: DataFrame) -> DataFrame:
    """One row: recall of both points in both scopes, real false positives, files.
    A file is a distinct (tic, sector)."""
    f = flagged(test_rows(record))
    file = F.struct("tic", "sector")
    aggs = [F.countDistinct(file).alias("n_files"),
            F.countDistinct(F.when(F.col("real_neg"), file)).alias("n_real_files")]
    for s in SCOPES:
        aggs.append(F.count_if(F.col(s)).alias(f"n_{s}"))
        aggs += [F.avg(F.when(F.col(s), F.col(f"op_{p}").cast("double"))).alias(f"recall_{s}_{p}") for p in POINTS]
    aggs += [F.count_if(F.col("real_neg") & F.col(f"op_{p}")).alias(f"fp_{p}") for p in POINTS]
    return f.agg(*aggs)


def operating_point_table(record: DataFrame) -> DataFrame:
    one = incumbent_points(record)
    cells = F.array(*[F.struct(F.lit(p).alias("point"), F.lit(s).alias("scope"), F.col(f"n_{s}").alias("n_positive"),
                               F.col(f"recall_{s}_{p}").alias("recall"), F.col(f"fp_{p}").alias("real_fp"),
                               (lit(1000) * F.col(f"fp_{p}") / F.greatest(F.col("n_files"), F.lit(1))).alias("fp_per_1000"),
                               F.col("n_files").alias("n_files"))
                      for p in POINTS for s in SCOPES])
    return one.select(F.explode(cells).alias("c")).select("c.*")


FLAGS = [*SCOPES, "real_neg", *[f"op_{p}" for p in POINTS]]


def arm_rows(record: DataFrame, arms: dict[str, str]) -> DataFrame:
    """The narrow table of an evaluation, written once: one row for each arm and test row with the
    arm's score (a column of the record), the file and the flags.  All that follows reads only this."""
    pairs = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(c).alias("score")) for a, c in arms.items()])
    keep = ["tic", "sector", "depth", "label", "label_source", "t_dur", "snr", "n_detrend_detections",
            "skye_flag", "best_fit", *dict.fromkeys(arms.values())]
    rows = flagged(test_rows(record).select(*keep)).select(F.explode(pairs).alias("_a"), "tic", "sector", *FLAGS)
    return materialise(rows.select("_a.*", "tic", "sector", *FLAGS), "arm-rows")


def _arm_points(rows: DataFrame) -> DataFrame:
    """One row per arm: what :func:`incumbent_points` has of the test rows (the same for every arm)."""
    file = F.struct("tic", "sector")
    aggs = [F.countDistinct(file).alias("n_files"), F.countDistinct(F.when(F.col("real_neg"), file)).alias("n_real_files")]
    for p in POINTS:
        aggs += [F.avg(F.when(F.col(s), F.col(f"op_{p}").cast("double"))).alias(f"recall_{s}_{p}") for s in SCOPES]
        aggs.append(F.count_if(F.col("real_neg") & F.col(f"op_{p}")).alias(f"fp_{p}"))
    return materialise(rows.groupBy("arm").agg(*aggs), "arm-points")


def arm_thresholds(rows: DataFrame) -> DataFrame:
    """One row per arm: the score thresholds ``tau_<scope>_<point>`` at which the arm keeps the same
    share of positives as the incumbent's points, beside those shares and counts."""
    one = _arm_points(rows)
    table = one.select("arm", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scope"), *[(lit(1) - F.col(f"recall_{s}_{p}")).alias(f"q_{p}") for p in POINTS])
        for s in SCOPES])).alias("c")).select("arm", "c.*")
    pos = rows.select("arm", "score", F.explode(F.filter(F.array(*[F.when(F.col(s), F.lit(s)) for s in SCOPES]), lambda x: x.isNotNull())).alias("scope"))
    taus = quantiles(pos, ["arm", "scope"], "score", {f"tau_{p}": f"q_{p}" for p in POINTS}, table, ["arm", "scope"])
    wide = taus.groupBy("arm").agg(*[F.max(F.when(F.col("scope") == s, F.col(f"tau_{p}"))).alias(f"tau_{s}_{p}")
                                     for s in SCOPES for p in POINTS])
    return materialise(one.join(wide, "arm", "left"), "arm-thresholds")


def _with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    # One threshold row per arm, so at most as many rows as there are arms are broadcast.
    return rows.join(F.broadcast(thresholds), "arm")


def matched_recall(record: DataFrame, arms: dict[str, str]) -> DataFrame:
    """:func:`matched_of` of score columns of the record."""
    return matched_of(arm_rows(record, arms))


def matched_of(rows: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Per (arm, point, scope): threshold, false positives among real negatives,
    true positives kept, and rates per 1,000 files."""
    thresholds = arm_thresholds(rows) if thresholds is None else thresholds
    aggs = []
    for s in SCOPES:
        for p in POINTS:
            kept = F.col("score") >= F.col(f"tau_{s}_{p}")
            aggs += [F.count_if(F.col("real_neg") & kept).alias(f"f_{s}_{p}"), F.count_if(F.col(s) & kept).alias(f"tp_{s}_{p}")]
    one = _with_thresholds(rows, thresholds).groupBy("arm").agg(*aggs).join(F.broadcast(thresholds), "arm")
    files = F.greatest(F.col("n_real_files"), F.lit(1))
    cells = F.array(*[F.struct(
        F.lit(p).alias("point"), F.lit(s).alias("scope"), F.col(f"recall_{s}_{p}").alias("base_recall"),
        F.col(f"tau_{s}_{p}").alias("tau"), F.col(f"f_{s}_{p}").alias("fp"),
        (lit(1000) * F.col(f"f_{s}_{p}") / files).alias("fp_per_1000"),
        (lit(1000) * F.col(f"fp_{p}") / files).alias("base_fp_per_1000"),
        (F.col(f"f_{s}_{p}") + F.col(f"tp_{s}_{p}")).alias("queue"))
        for p in POINTS for s in SCOPES])
    return one.select("arm", F.explode(cells).alias("c")).select("arm", "c.*")


def ablation_contrast(matched: DataFrame, full: str, reduced: str) -> DataFrame:
    """False positives per arm side by side and ``reduced - full``."""
    arms = [full, reduced]
    wide = matched.groupBy("point", "scope").pivot("arm", arms).agg(F.first("fp"))
    return wide.withColumn("contrast", F.col(reduced) - F.col(full))


def resampled(per: DataFrame, key: str, columns: list[str], n_resamples: int, seed: str, members: int = 256, draws: int = 1 << 16) -> DataFrame:
    """(b, sums of ``columns``) over n draws with replacement from the n rows of ``per``, for each resample b.

    A multinomial draw in two steps. Rows in order of ``key`` lie in blocks of ``members``. First every draw falls into a
    block, counted where it is made (``draws`` at a time); then each block deals its count to its own rows, beside
    their values. What is shuffled are counts per resample and block, not the draws."""
    place = cumulative(per, [], key, {"one": F.lit(1)}).select(key, F.col("one_below").alias("_at"))
    numbered = materialise(per.join(place, key).select("_at", *columns), "numbered")
    n = numbered.count()
    at = F.floor(F.col("_at") / members).alias("block")
    rows = numbered.groupBy(at).agg(F.array_sort(F.collect_list(F.struct("_at", *columns))).alias("rows"))  # ``members`` at most
    steps = -(-n // draws)
    first = F.col("id") % F.lit(max(1, steps)) * draws
    slots = per.sparkSession.range(n_resamples * steps).select(
        F.floor(F.col("id") / F.lit(max(1, steps))).alias("b"), F.explode(F.sequence(first, F.least(first + draws, F.lit(n)) - 1)).alias("slot"))
    fallen = slots.groupBy("b", F.floor(F.floor(uniform(seed, F.col("b"), F.col("slot")) * n) / members).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    dealt = fallen.join(rows, "block").select("b", "block", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    pick = F.floor(uniform(seed + ".in", F.col("b"), F.col("block"), F.col("j")) * F.size("rows")).cast("int")
    return dealt.select("b", F.element_at("rows", pick + 1).alias("r")).groupBy("b").agg(*[F.sum(f"r.{c}").alias(c) for c in columns])


def cluster_bootstrap(record: DataFrame, arms: dict[str, str], n_resamples: int = 2000,
                      seed: str = "boot") -> DataFrame:
    """:func:`bootstrap_of` of score columns of the record."""
    return bootstrap_of(arm_rows(record, arms), n_resamples, seed)


def bootstrap_of(rows: DataFrame, n_resamples: int = 2000, seed: str = "boot", thresholds: DataFrame | None = None) -> DataFrame:
    """2.5 / 97.5 percentiles of the false positive rate per 1,000 files over
    resamples of whole systems (fixed file denominator).

    Counts of all cells travel together; see :func:`resampled` for the draws."""
    thresholds = arm_thresholds(rows) if thresholds is None else thresholds
    arms = sorted(r["arm"] for r in thresholds.select("arm").collect())  # a few names
    neg = _with_thresholds(rows.where("real_neg"), thresholds)
    cells = {(a, s, p): F.count_if((F.col("arm") == a) & (F.col("score") >= F.col(f"tau_{s}_{p}")))
             for a in arms for s in SCOPES for p in POINTS}
    names = {c: f"c{i}" for i, c in enumerate(cells)}
    per = materialise(neg.groupBy("tic").agg(
        F.collect_set("sector").alias("_sectors"), *[e.alias(names[c]) for c, e in cells.items()]), "fp-per-system")
    sums = resampled(per, "tic", list(names.values()), n_resamples, seed)
    files = scalar(per, F.sum(F.size("_sectors")))
    rate = {n: lit(1000) * F.col(n) / F.greatest(files, F.lit(1)) for n in names.values()}
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("scope"), F.lit(p).alias("point"),
                                                    rate[n].alias("rate")) for (a, s, p), n in names.items()])).alias("c"))
    return long.select("c.*").groupBy("arm", "scope", "point").agg(
        F.percentile("rate", F.lit(0.025)).alias("lo"), F.percentile("rate", F.lit(0.975)).alias("hi"),
        F.avg("rate").alias("mean_rate"))


def recall_at_budget(record: DataFrame, arms: dict[str, str]) -> DataFrame:
    """:func:`budget_of` of score columns of the record."""
    return budget_of(arm_rows(record, arms))


def budget_of(rows: DataFrame) -> DataFrame:
    """Recall at the incumbent's false positive budget: the threshold is the k-th
    largest score of the real negatives, k the incumbent's count."""
    budget = _arm_points(rows).select("arm", "n_files", *[F.col(f"fp_{p}").alias(f"k_{p}") for p in POINTS])
    c = cumulative(rows.where("real_neg"), ["arm"], "score", {"n": F.lit(1)}).join(F.broadcast(budget), "arm")
    above = F.col("n_total") - F.col("n_below") - F.col("n")
    taus = c.groupBy("arm").agg(F.max("n_files").alias("n_files"), *[F.max(f"k_{p}").alias(f"k_{p}") for p in POINTS], *[
        F.max(F.when((above < F.col(f"k_{p}")) & (above + F.col("n") >= F.col(f"k_{p}")), F.col("score"))).alias(f"tau_{p}")
        for p in POINTS])
    aggs = [F.max("n_files").alias("n_files")]
    for p in POINTS:
        kept = F.col("score") >= F.col(f"tau_{p}")
        aggs += [F.max(f"tau_{p}").alias(f"t_{p}"), F.max(f"k_{p}").alias(f"k_{p}"),
                 F.count_if(F.col("real_neg") & kept).alias(f"fp_{p}")]
        aggs += [F.avg(F.when(F.col(s), kept.cast("double"))).alias(f"r_{s}_{p}") for s in SCOPES]
    cells = F.array(*[F.struct(F.lit(p).alias("point"), F.lit(s).alias("scope"), F.col(f"k_{p}").alias("fp_budget"),
                               F.col(f"t_{p}").alias("tau"), F.col(f"fp_{p}").alias("fp"), F.col(f"r_{s}_{p}").alias("recall"),
                               (lit(1000) * F.col(f"k_{p}") / F.col("n_files")).alias("budget_per_1000_files"))
                      for p in POINTS for s in SCOPES])
    # One threshold row per arm, so at most len(arms) rows are broadcast.
    return (rows.join(F.broadcast(taus), "arm").groupBy("arm").agg(*aggs)
            .select("arm", F.explode(cells).alias("c")).select("arm", "c.*"))


# --- histograms, completeness, rollups ---------------------------------------

def joint_histogram(events: DataFrame, d_phi: str, d_gap: str) -> DataFrame:
    """Counts on the full (phase, gap) grid; rows outside the edges are left out."""
    g = k.GAP_EDGES
    inside = F.col(d_phi).between(lit(0), lit(k.PHASE_MAX)) & F.col(d_gap).between(lit(g[0]), lit(g[-1]))
    n = (events.where(inside)
         .groupBy(bin_of(F.col(d_phi), 0.0, k.PHASE_MAX, k.PHASE_BINS).alias("phase_bin"),
                  bin_of_edges(F.col(d_gap), g).alias("gap_bin")).agg(F.count(F.lit(1)).alias("_n")))
    grid = events.sparkSession.range(k.PHASE_BINS * (len(g) - 1)).select(
        F.floor(F.col("id") / (len(g) - 1)).cast("int").alias("phase_bin"), (F.col("id") % (len(g) - 1)).cast("int").alias("gap_bin"))
    return grid.join(n, ["phase_bin", "gap_bin"], "left").select(
        "phase_bin", "gap_bin", F.coalesce("_n", F.lit(0)).alias("n"))


def test_verdicts(events: DataFrame, tau: float) -> DataFrame:
    """Per test: lead events, their best score, and whether it reaches ``tau``."""
    return (events.where("is_lead = 1").groupBy("model_idx")
            .agg(F.count(F.lit(1)).alias("n_lead_events"), F.max("score").alias("max_lead_score"))
            .withColumn("vetter_pass", (F.col("max_lead_score") >= lit(tau)).cast("int")))


def completeness(tests: DataFrame, series: Column, n_bins: Column, x: str = "rp_over_rstar_model") -> DataFrame:
    """Recovered and passing fractions per bin of ``x`` with one-sigma Wilson
    bounds; every series shows its whole grid, empty cells hold NULL.

    ``series``: array of series names of a row; ``n_bins``: bins of a series."""
    box = scalar(tests, F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")))
    lo, hi = box.getField("lo"), box.getField("hi")
    rows = (tests.select(x, "recovered", "vetter_pass", F.explode(series).alias("series"))
            .withColumn("_n", n_bins))
    raw = F.floor((F.col(x) - lo) / (hi - lo) * F.col("_n"))
    cell = (rows.withColumn("bin", F.least(F.greatest(raw, F.lit(0)), F.col("_n") - 1).cast("int"))
            .groupBy("series", "_n", "bin")
            .agg(F.count(F.lit(1)).alias("n_tests"), F.sum("recovered").alias("n_recovered"),
                 F.count_if((F.col("recovered") == 1) & (F.col("vetter_pass") == 1)).alias("n_pass")))
    grid = (cell.select("series", "_n").distinct()
            .select("series", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("bin")))
    out = grid.join(cell, ["series", "_n", "bin"], "left").fillna(0, ["n_tests", "n_recovered", "n_pass"])
    r = wilson(F.col("n_recovered"), F.col("n_tests"), 1.0)
    p = wilson(F.col("n_pass"), F.col("n_recovered"), 1.0)
    step = (hi - lo) / F.col("_n")
    return out.select(
        "series", "bin", (lo + step * F.col("bin")).alias("bin_lo"), (lo + step * (F.col("bin") + 1)).alias("bin_hi"),
        "n_tests", "n_recovered", "n_pass",
        F.when(F.col("n_tests") > 0, F.col("n_recovered") / F.col("n_tests")).alias("recovered_frac"),
        r[0].alias("recovered_lo"), r[1].alias("recovered_hi"),
        F.when(F.col("n_recovered") > 0, F.col("n_pass") / F.col("n_recovered")).alias("pass_frac"),
        p[0].alias("pass_lo"), p[1].alias("pass_hi"))


def balance(df: DataFrame, keys: Sequence[str], flag: str, gate: float = k.GATE_MIX) -> DataFrame:
    """Share of ``flag`` per group against an even mix."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(flag).alias("rate"))
            .withColumn("gate_pass", (F.abs(F.col("rate") - lit(0.5)) <= lit(gate)).cast("int")))


def queue_summary(events: DataFrame, tau: float, overlap: str = "overlap") -> DataFrame:
    q = quantiles(events, [], "score", {"q50": 0.5, "q90": 0.9, "q99": 0.99})
    box = scalar(q, F.struct("q50", "q90", "q99"))
    return events.agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("tic").alias("n_systems"),
        F.count_if(F.col("score") >= lit(tau)).alias("n_above_tau"),
        F.countDistinct(F.when(F.col(overlap) == 1, F.struct("tic", "sector"))).alias("overlap_files"),
        F.count_if(F.col(overlap) == 1).alias("overlap_events")).select(
        "*", *[box.getField(c).alias(c) for c in ("q50", "q90", "q99")])


def expected_yield(hosts: DataFrame, n_models: int = 24, seed: str = "yield") -> DataFrame:
    """Chance per host of at least one detected pair over ``n_models`` draws of
    dispersion, planet period and recovery.  ``hosts``: tic, period, p_crit, t_obs."""
    key = (F.col("tic"), F.col("m"))
    u = lambda s: uniform(f"{seed}.{s}", *key)
    rows = hosts.where(F.col("t_obs") > 0).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))))
    log_sigma = F.when(u("tight") < lit(0.60), lit(-4) + u("s")).otherwise(lit(-3) + u("s"))
    xs, ys = [math.log10(s) for s in k.YIELD_SIGMA], k.YIELD_FRACTION
    f2 = F.when(F.col("_ls") <= lit(xs[0]), lit(ys[0]))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        f2 = f2.when(F.col("_ls") <= lit(x1), lit(y0) + (F.col("_ls") - lit(x0)) * lit((y1 - y0) / (x1 - x0)))
    f2 = f2.otherwise(lit(ys[-1]))
    mean, sd, lo, hi = k.YIELD_RECOVERY
    r1, r2 = (clip(lit(mean) + lit(sd) * normal(f"{seed}.{w}", *key), lo, hi) for w in ("lead", "partner"))
    lam = (F.col("t_obs") / F.col("_pp")) * F.col("_f2") * lit(k.YIELD_DUTY) * r1 * r2
    rows = (rows.withColumn("_ls", log_sigma).withColumn("_f2", f2)
            .withColumn("_pp", physics.planet_period(F.col("p_crit"), seed, *key))
            .withColumn("_lam", lam)
            .withColumn("_pm", (lit(1) - F.exp(-F.col("_lam"))) * lit(k.YIELD_ATTRITION)))
    return rows.groupBy("tic").agg(
        F.max("t_obs").alias("t_obs"), F.median("_lam").alias("median_lambda"),
        (lit(1) - F.exp(F.sum(F.log1p(-F.col("_pm"))))).alias("p_host"))


def expected_yield_total(per_host: DataFrame) -> DataFrame:
    return per_host.agg(F.count(F.lit(1)).alias("n_hosts"), F.sum("p_host").alias("expected"),
                        F.count_if(F.col("p_host") > lit(0.5)).alias("n_above_half")).withColumn(
        "verdict", F.when(F.col("expected") >= k.YIELD_FLOOR, "POSITIVE").otherwise("NEGATIVE"))


def folded_profile(lc: DataFrame, n_bins: int, separation: float, width_at: float = 0.10) -> DataFrame:
    """Median flux per phase bin and system, its two deepest well-separated bins
    and their circular widths where the dip exceeds ``width_at`` of its peak."""
    rows = lc.withColumn("_bin", bin_of(F.col("phase"), 0.0, 1.0, n_bins))
    prof = quantiles(rows, ["tic", "_bin"], "flux", {"m": 0.5})
    # At most n_bins values per system from here on.
    per = prof.groupBy("tic").agg(F.median("m").alias("_base"), F.sum("n").alias("n_cadences"),
                                  F.map_from_entries(F.collect_list(F.struct("_bin", "m"))).alias("_m"))
    grid = F.sequence(F.lit(0), F.lit(n_bins - 1))
    d = per.withColumn("_d", F.transform(grid, lambda i: F.col("_base") - F.element_at(F.col("_m"), i)))

    def deepest(allowed) -> Column:
        items = F.filter(F.transform(grid, lambda i: F.struct(F.get(F.col("_d"), i).alias("d"), (-i).alias("i"))),
                         lambda s: s.getField("d").isNotNull() & allowed(-s.getField("i")))
        return F.array_max(items)

    def centre(i: Column) -> Column:
        return (i + lit(0.5)) / lit(n_bins)

    d = d.withColumn("_p1", deepest(lambda i: F.lit(True))).withColumn("i1", -F.col("_p1.i"))
    gap = lambda i: F.abs((centre(i) - centre(F.col("i1")) + lit(0.5)) - F.floor(centre(i) - centre(F.col("i1")) + lit(0.5)) - lit(0.5))
    d = d.withColumn("_p2", deepest(lambda i: gap(i) > lit(separation))).withColumn("i2", -F.col("_p2.i"))

    def width(i: str, peak: str) -> Column:
        def run(sign: int) -> Column:
            stop = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(n_bins // 2)), lambda j: ~F.coalesce(
                F.get(F.col("_d"), F.pmod(F.col(i) + F.lit(sign) * j, F.lit(n_bins))) > lit(width_at) * F.col(peak), F.lit(False))))
            return F.coalesce(stop - 1, F.lit(n_bins // 2))
        return F.when(F.col(i).isNotNull(), (run(-1) + run(1) + 1) / lit(n_bins))

    return d.select("tic", "n_cadences", centre(F.col("i1")).alias("prim_pos"), F.col("_p1.d").alias("prim_depth"),
                    width("i1", "_p1.d").alias("prim_width"), centre(F.col("i2")).alias("sec_pos"),
                    F.col("_p2.d").alias("sec_depth"), width("i2", "_p2.d").alias("sec_width"))
