"""Queries: cleaning, predicates, host columns, gaps (P*, W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions import expr, physics
from dipsift.functions.expr import lit
from dipsift.operators import clean, gaps, hosts
from dipsift.plans.registry import query

H = ["tic", "prim_pos", "prim_width", "sec_pos", "sec_width"]


def eclipses():
    return ((F.col("prim_pos"), F.col("prim_width")), (F.col("sec_pos"), F.col("sec_width")))


CIRC = "abs(({0} - {1} + 0.5e0) - floor({0} - {1} + 0.5e0) - 0.5e0)"


@query("p1_crowding_normalise", """
WITH m AS (SELECT *, 0.8e0 + (tic % 5) * 4e-2 AS crowd, 0.9e0 - (sector % 3) * 5e-2 AS frac_in,
             median(nullif(flux, 0e0)) OVER (PARTITION BY tic, sector) AS med FROM lc),
c AS (SELECT *, (flux - (1e0 - crowd) * med) / frac_in AS f2 FROM m),
n AS (SELECT *, median(f2) OVER (PARTITION BY tic, sector) AS med2 FROM c)
SELECT tic, sector, event_id, f2 / med2 AS flux, flux_err / frac_in / med2 AS flux_err FROM n
""", "flux flux_err")
def p1(v):
    df = clean.crowding_corrected(v.lc, lit(0.8) + (F.col("tic") % 5) * lit(4e-2),
                                  lit(0.9) - (F.col("sector") % 3) * lit(5e-2))
    return df.select("tic", "sector", "event_id", "flux", "flux_err")


@query("p2_finite_rows", """
SELECT tic, sector, count(*) AS n_kept, min(time) AS t_min FROM lc
WHERE time IS NOT NULL AND event_type <> 'error' GROUP BY tic, sector
""", "t_min")
def p2(v):
    holed = v.lc.withColumn("flux", F.when(F.col("event_type") != "error", F.col("flux"))
                            .otherwise(lit(float("nan"))))
    return clean.finite_rows(holed).groupBy("tic", "sector").agg(
        F.count(lit(1)).alias("n_kept"), F.min("time").alias("t_min"))


@query("p3_phase_fold", """
SELECT l.tic, l.event_id, (l.time - h.bjd0) / h.period - floor((l.time - h.bjd0) / h.period) AS phase
FROM lc l JOIN host h ON h.tic = l.tic""", "phase")
def p3(v):
    return hosts.lookup(v.lc.drop("phase"), v.ephemeris, ["event_id"]).select(
        "tic", "event_id", expr.fold(F.col("time"), F.col("bjd0"), F.col("period")).alias("phase"))


@query("p4_eclipse_mask", f"""
SELECT l.tic, l.sector, count(*) AS n_cadences,
  count(*) FILTER (WHERE coalesce({CIRC.format('l.phase', 'h.prim_pos')} <= h.prim_width / 2e0, false)
    OR coalesce({CIRC.format('l.phase', 'h.sec_pos')} <= h.sec_width / 2e0, false)) AS n_masked
FROM lc l JOIN host h ON h.tic = l.tic GROUP BY l.tic, l.sector""")
def p4(v):
    df = hosts.lookup(v.lc, v.host.select(*H), ["event_id"])
    return df.groupBy("tic", "sector").agg(
        F.count(lit(1)).alias("n_cadences"),
        F.count_if(expr.in_eclipse(F.col("phase"), *eclipses())).alias("n_masked"))


@query("p5_out_of_eclipse", f"""
SELECT l.tic, l.sector, l.event_id, l.flux FROM lc l JOIN host h ON h.tic = l.tic
WHERE {CIRC.format('l.phase', 'h.prim_pos')} > 1.6e0 * h.prim_width
  AND {CIRC.format('l.phase', 'h.sec_pos')} > 1.6e0 * coalesce(h.sec_width, 2e-2)""", "flux")
def p5(v):
    df = hosts.lookup(v.lc, v.host.select(*H), ["event_id"])
    return df.where(expr.outside_widened(F.col("phase"), *eclipses())).select(
        "tic", "sector", "event_id", "flux")


EDGE_DISTANCE = f"""least(greatest(0e0, {CIRC.format('t.phase', 'h.prim_pos')} - h.prim_width / 2e0),
   CASE WHEN h.sec_width IS NOT NULL THEN greatest(0e0, {CIRC.format('t.phase', 'h.sec_pos')} - h.sec_width / 2e0) END)"""


@query("p6_eclipse_phase_distance", f"""
SELECT t.event_id, {EDGE_DISTANCE} AS d_phi, coalesce({EDGE_DISTANCE}, 0e0) AS d_phi_or_zero
FROM tce t JOIN host h ON h.tic = t.tic""", "d_phi d_phi_or_zero")
def p6(v):
    d = expr.eclipse_edge_distance(F.col("phase"), *eclipses())
    return hosts.lookup(v.tce, v.host.select(*H), ["event_id"]).select(
        "event_id", d.alias("d_phi"), F.coalesce(d, lit(0)).alias("d_phi_or_zero"))


@query("p7_long_cadence_rebin", f"""
WITH d AS (SELECT *, time - lag(time) OVER (PARTITION BY tic, sector ORDER BY time) AS step FROM lc),
p AS (SELECT tic, sector, median(step) AS pace FROM d GROUP BY tic, sector),
j AS (SELECT lc.*, p.pace FROM lc JOIN p ON p.tic = lc.tic AND p.sector = lc.sector),
r AS (SELECT tic, sector, avg(time) AS time, avg(flux) AS flux, sqrt(sum(flux_err * flux_err)) / count(*) AS flux_err
FROM j WHERE pace < 0.35e0 GROUP BY tic, sector, floor(time / 0.35e0)
UNION ALL
SELECT tic, sector, time, flux, flux_err FROM j WHERE NOT coalesce(pace < 0.35e0, false)),
f AS (SELECT r.*, (r.time - h.bjd0) / h.period - floor((r.time - h.bjd0) / h.period) AS phase, prim_pos, prim_width, sec_pos, sec_width
  FROM r LEFT JOIN host h ON h.tic = r.tic)
SELECT tic, sector, time, flux, flux_err, phase, CASE WHEN coalesce({CIRC.format('phase', 'prim_pos')} <= prim_width / 2e0, false)
    OR coalesce({CIRC.format('phase', 'sec_pos')} <= sec_width / 2e0, false) THEN 1 ELSE 0 END AS ecl_mask FROM f
""", "time flux flux_err phase")
def p7(v):
    return clean.rephased(clean.long_cadence(v.lc, 0.35), v.host)


@query("p8_inversion", """
SELECT event_id, CASE WHEN event_id % 2 = 1 THEN ((flux - 1e0) * -1e0) + 1e0 ELSE flux END AS flux FROM lc
""", "flux")
def p8(v):
    return v.lc.select("event_id", clean.inverted(F.col("flux"), F.col("event_id") % 2).alias("flux"))


@query("p9_operating_points", """
SELECT event_id,
  CASE WHEN snr >= 5e0 AND duration <= 1e0 AND n_detrend_detections > 18 AND coalesce(skye_flag, 0) = 0
       THEN 1 ELSE 0 END AS passes_a,
  CASE WHEN snr >= 5e0 AND duration <= 1e0 AND n_detrend_detections > 18 AND coalesce(skye_flag, 0) = 0
        AND best_fit IN ('T', 'AT') THEN 1 ELSE 0 END AS passes_b
FROM tce""")
def p9(v):
    return v.tce.select("event_id", expr.operating_point("A").cast("int").alias("passes_a"),
                        expr.operating_point("B").cast("int").alias("passes_b"))


ORBIT_SQL = """
WITH a AS (SELECT *, (1.5707963267948966e0) * ((sec_pos - prim_pos) - floor(sec_pos - prim_pos) - 0.5e0) AS ec,
  CASE WHEN sec_width + prim_width > 0 THEN (sec_width - prim_width) / (sec_width + prim_width) ELSE 0e0 END AS es
  FROM host),
b AS (SELECT *, coalesce(least(sqrt(ec * ec + es * es), 0.95e0), 0e0) AS ecc FROM a),
c AS (SELECT *, least(greatest(ecc, 0e0), 0.8e0) AS x FROM b),
o AS (SELECT *, period * pow(1.6e0 + 5.1e0 * x - 2.22e0 * x * x + 4.12e0 * 0.3e0 - 4.27e0 * x * 0.3e0
   - 5.09e0 * 0.3e0 * 0.3e0 + 4.61e0 * x * x * 0.3e0 * 0.3e0, 1.5e0) AS p_crit FROM c)
"""


@query("p10_host_orbit", ORBIT_SQL + "SELECT tic, ec AS e_cos_w, es AS e_sin_w, ecc, p_crit FROM o",
       "e_cos_w e_sin_w ecc p_crit")
def p10(v):
    ec, es, _ = physics.eccentricity(*[F.col(c) for c in ("prim_pos", "sec_pos", "prim_width", "sec_width")])
    return hosts.orbit_columns(v.host).select("tic", ec.alias("e_cos_w"), es.alias("e_sin_w"), "ecc", "p_crit")


@query("p11_host_table", ORBIT_SQL + """
SELECT tic, period, ecc, p_crit, sec_depth / prim_depth AS depth_ratio_raw,
  least(greatest(CASE WHEN sec_depth / prim_depth > 0 THEN sec_depth / prim_depth ELSE 1e0 END, 5e-2), 1e0) AS depth_ratio,
  log10(p_crit / period) AS log10_pp_over_pbin,
  CASE WHEN p_crit > period * pow(1e0 / 0.3e0 + 1e0, 3) THEN 1e0 ELSE 0e0 END AS same_star_multi_allowed
FROM o""", "period ecc p_crit depth_ratio_raw depth_ratio log10_pp_over_pbin same_star_multi_allowed")
def p11(v):
    noise = v.host.select("tic", (F.col("sec_depth") / F.col("prim_depth")).alias("depth_ratio"))
    return hosts.host_table(v.host, noise).select(
        "tic", "period", "ecc", "p_crit", "depth_ratio_raw", "depth_ratio",
        "log10_pp_over_pbin", "same_star_multi_allowed")


@query("p13_pair_ratio_vs_expectation", """
SELECT model, event_id, CASE WHEN depth_ratio > 0 THEN log10(greatest(depth * 1e2, 1e-6) / depth_ratio) END AS log_ratio
FROM crossings""", "log_ratio")
def p13(v):
    return v.crossings.select("model", "event_id", expr.pair_depth_log_ratio(
        F.col("depth") * lit(100), F.col("depth_ratio")).alias("log_ratio"))


@query("p14_pair_window", """
SELECT event_id, greatest(0.15e0, t.duration) AS lo, 0.5e0 * h.period AS hi,
  CASE WHEN 0.5e0 * h.period > greatest(0.15e0, t.duration) THEN 1 ELSE 0 END AS representable
FROM tce t JOIN host h ON h.tic = t.tic""", "lo hi")
def p14(v):
    lo, hi = expr.pair_window(F.col("period"), F.col("duration"))
    return hosts.lookup(v.tce, v.ephemeris, ["event_id"]).select(
        "event_id", lo.alias("lo"), hi.alias("hi"), (hi > lo).cast("int").alias("representable"))


@query("p17_depth_stratum", "SELECT rec_id, depth FROM record WHERE depth BETWEEN 0.0015e0 AND 0.0030e0", "depth")
def p17(v):
    return v.record.where(expr.in_stratum(F.col("depth"))).select("rec_id", "depth")


NOISE_SQL = """noise AS (SELECT l.tic, stddev_pop(l.flux) AS rms_cadence, count(DISTINCT l.sector) AS n_files,
   any_value(h.sec_depth / h.prim_depth) AS depth_ratio, any_value(h.prim_depth) AS prim_depth
   FROM lc l JOIN host h ON h.tic = l.tic GROUP BY l.tic)"""


def noise_view(v):
    rms = v.lc.groupBy("tic").agg(F.stddev_pop("flux").alias("rms_cadence"),
                                  F.countDistinct("sector").alias("n_files"))
    return rms.join(v.host.select("tic", "prim_depth", (F.col("sec_depth") / F.col("prim_depth"))
                                  .alias("depth_ratio")), "tic")


@query("p18_pair_host_screen", f"""WITH {NOISE_SQL}, g AS (
  SELECT * FROM (VALUES (0.005e0, 5e0), (0.005e0, 1e0), (0.003e0, 5e0), (0.003e0, 1e0)) x(ref_depth, snr_min)),
r AS (SELECT g.*, depth_ratio, prim_depth,
   depth_ratio * ref_depth / (rms_cadence / sqrt(12e0)) >= snr_min AS det
   FROM noise, g WHERE depth_ratio IS NOT NULL)
SELECT ref_depth, snr_min, count(*) FILTER (WHERE det) AS n_detectable,
  count(*) FILTER (WHERE det AND depth_ratio >= 0.33e0) AS n_physical,
  count(*) FILTER (WHERE det AND depth_ratio >= 0.33e0 AND prim_depth >= 0.3e0) AS n_strong
FROM r GROUP BY ref_depth, snr_min""", "ref_depth snr_min")
def p18(v):
    return hosts.screen_grid(noise_view(v), (0.005, 0.003), (5.0, 1.0))


@query("p19_real_crossings", """
SELECT model, cycle, star, event_id, impact FROM crossings
WHERE abs(impact) < 1e0 AND egress - ingress >= 1e-4 AND body >= 3""", "impact")
def p19(v):
    return clean.real_crossings(v.crossings).select("model", "cycle", "star", "event_id", "impact")


EPHEMERIS_SQL = """WITH d AS (SELECT l.tic, l.event_id, l.time, h.period, h.bjd0,
  abs(l.time - (h.bjd0 + round_even((l.time - h.bjd0) / h.period, 0) * h.period)) AS d_primary,
  abs(l.time - (h.bjd0 + h.sec_pos * h.period
     + round_even((l.time - (h.bjd0 + h.sec_pos * h.period)) / h.period, 0) * h.period)) AS d_secondary
  FROM lc l JOIN host h ON h.tic = l.tic WHERE l.flux < 0.995e0),
e AS (SELECT *, CASE WHEN d_primary < 0.3e0 AND d_primary <= d_secondary THEN 'primary'
   WHEN d_secondary < 0.3e0 AND d_secondary < d_primary THEN 'secondary' ELSE 'neither' END AS kind FROM d),
r AS (SELECT *, CASE WHEN kind = 'primary' THEN
  (time - (bjd0 + round_even((time - bjd0) / period, 0) * period)) * 1440e0 END AS residual_min FROM e)
"""


def ephemeris_events(v):
    df = hosts.lookup(v.lc.where(F.col("flux") < lit(0.995)), v.host.select("tic", "period", "bjd0", "sec_pos"),
                      ["event_id"])
    return df.withColumns(clean.ephemeris_match(
        F.col("time"), F.col("period"), F.col("bjd0"),
        F.col("bjd0") + F.col("sec_pos") * F.col("period")))


@query("p20_ephemeris_match", EPHEMERIS_SQL
       + "SELECT tic, event_id, d_primary, d_secondary, kind, residual_min FROM r",
       "d_primary d_secondary residual_min")
def p20(v):
    return ephemeris_events(v).select("tic", "event_id", "d_primary", "d_secondary", "kind", "residual_min")


@query("p20_ephemeris_residuals", EPHEMERIS_SQL + """
SELECT kind, count(*) AS n, median(abs(residual_min)) AS median_abs_min, max(abs(residual_min)) AS max_abs_min
FROM r GROUP BY kind""", "median_abs_min max_abs_min", 6)
def p20_summary(v):
    from dipsift.operators.rank import quantiles
    df = ephemeris_events(v).withColumn("_a", F.abs("residual_min"))
    counts = df.groupBy("kind").agg(F.count(lit(1)).alias("n"), F.max("_a").alias("max_abs_min"))
    med = quantiles(df, ["kind"], "_a", {"median_abs_min": 0.5}).drop("n")
    return counts.join(med, "kind", "left")


EDGES_SQL = """edges AS (SELECT tic, sector, time FROM (
  SELECT tic, sector, time, lag(time) OVER w AS p, lead(time) OVER w AS q FROM lc
  WINDOW w AS (PARTITION BY tic, sector ORDER BY time))
  WHERE p IS NULL OR q IS NULL OR time - p > 0.5e0 OR q - time > 0.5e0),
sized AS (SELECT tic, sector FROM lc GROUP BY tic, sector HAVING count(*) >= 2)"""


@query("w1_gap_edges", f"WITH {EDGES_SQL} SELECT tic, sector, time FROM edges", "time")
def w1_edges(v):
    return gaps.gap_edges(v.lc).select("tic", "sector", "time")


@query("w1_event_gap_distance", f"""WITH {EDGES_SQL}
SELECT t.event_id, min(abs(e.time - t.event_time)) AS gap_proximity
FROM tce t LEFT JOIN (SELECT * FROM edges SEMI JOIN sized USING (tic, sector)) e
  ON e.tic = t.tic AND e.sector = t.sector GROUP BY t.event_id""", "gap_proximity")
def w1_events(v):
    return gaps.gap_distance(v.lc, v.tce.select("tic", "sector", "event_id", "event_time"),
                             "event_time").select("event_id", "gap_proximity")


@query("w1_cadence_gap_distance", f"""WITH {EDGES_SQL}
SELECT t.event_id, min(abs(e.time - t.time)) AS gap_proximity
FROM lc t LEFT JOIN (SELECT * FROM edges SEMI JOIN sized USING (tic, sector)) e
  ON e.tic = t.tic AND e.sector = t.sector GROUP BY t.event_id""", "gap_proximity")
def w1_cadences(v):
    return gaps.gap_distance(v.lc, v.lc.select("tic", "sector", "event_id", "time"),
                             "time").select("event_id", "gap_proximity")


@query("w2_chunks", """
SELECT event_id, CAST(sum(CASE WHEN time - p > 0.75e0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY tic, sector ORDER BY time) AS BIGINT) AS chunk
FROM (SELECT *, lag(time) OVER (PARTITION BY tic, sector ORDER BY time) AS p FROM lc)""")
def w2(v):
    return gaps.chunks(v.lc.select("tic", "sector", "time", "event_id")).select("event_id", "chunk")


@query("w3_span_merge", """
WITH s AS (SELECT tic, sector, min(time) * (1 + sector) AS t_min, max(time) * (1 + sector) AS t_max
           FROM lc GROUP BY tic, sector),
p AS (SELECT *, CASE WHEN t_min - lag(t_max) OVER (PARTITION BY tic ORDER BY t_min) > 20e0 THEN 1 ELSE 0 END AS o FROM s),
g AS (SELECT *, CAST(sum(o) OVER (PARTITION BY tic ORDER BY t_min) AS BIGINT) AS window_id FROM p),
w AS (SELECT tic, window_id, count(*) AS n_files, floor((min(t_min) - 2e0) * 1e1) / 1e1 AS t0,
        ceil((max(t_max) + 2e0) * 1e1) / 1e1 AS t1 FROM g GROUP BY tic, window_id)
SELECT *, CAST(floor((t1 - t0) / 0.01e0 + 1000e0) AS BIGINT) AS n_points,
  CASE WHEN floor((t1 - t0) / 0.01e0 + 1000e0) >= 4000 THEN 1 ELSE 0 END AS over_cap FROM w
""", "t0 t1")
def w3(v):
    stretch = lit(1) + F.col("sector")
    spans = v.lc.groupBy("tic", "sector").agg(F.min("time").alias("a"), F.max("time").alias("z")).select(
        "tic", (F.col("a") * stretch).alias("t_min"), (F.col("z") * stretch).alias("t_max"))
    return gaps.sector_windows(spans, cap=4000)


GROUPS_SQL = """c AS (SELECT *, CAST(sum(CASE WHEN event_time - p > {tol} THEN 1 ELSE 0 END)
  OVER (PARTITION BY tic, sector ORDER BY event_time) AS BIGINT) AS group_id
  FROM (SELECT *, lag(event_time) OVER (PARTITION BY tic, sector ORDER BY event_time) AS p FROM tce))"""


@query("w4_tolerance_grouping", f"""WITH {GROUPS_SQL.format(tol='0.5e0')},
r AS (SELECT *, row_number() OVER (PARTITION BY tic, sector, group_id ORDER BY snr DESC, event_time) AS rn,
   count(*) OVER (PARTITION BY tic, sector, group_id) AS n FROM c)
SELECT tic, sector, group_id, event_time, snr, depth, duration, n AS n_detrend_detections,
  CASE WHEN n <= 2 THEN 1 ELSE 0 END AS det_dependence FROM r WHERE rn = 1""",
       "event_time snr depth duration")
def w4(v):
    peaks = v.tce.select("tic", "sector", "event_time", "snr", "depth", "duration")
    return gaps.best_of_groups(peaks, 0.5, carry=["depth", "duration"], threshold=2)


@query("w5_duplicate_groups", f"""WITH {GROUPS_SQL.format(tol='0.0209e0')}
SELECT event_id, group_id, count(*) OVER (PARTITION BY tic, sector, group_id) AS multiplicity,
  CASE WHEN row_number() OVER (PARTITION BY tic, sector, group_id ORDER BY snr DESC, event_time) = 1
  THEN 1 ELSE 0 END AS is_canonical FROM c""")
def w5(v):
    ev = v.tce.select("tic", "sector", "event_id", "event_time", "snr")
    return gaps.duplicate_groups(ev).select("event_id", "group_id", "multiplicity", "is_canonical")


@query("w6_cycle_index", """
SELECT t.event_id, l.event_id AS cadence_id,
  CAST(floor((l.time - (t.event_time - t.phase * h.period)) / h.period) AS BIGINT) AS cycle,
  CAST(floor((l.time - t.event_time) / h.period + 0.5e0) AS BIGINT) AS centred_cycle
FROM tce t JOIN host h ON h.tic = t.tic JOIN lc l ON l.tic = t.tic AND l.sector = t.sector
 AND abs(l.time - t.event_time) <= greatest(3e0 * t.duration, 0.75e0)""")
def w6(v):
    from dipsift.operators import views
    ev = hosts.lookup(v.tce, v.ephemeris, ["event_id"])
    pairs = views.event_windows(v.lc.select("tic", "sector", "time", F.col("event_id").alias("cadence_id")),
                                ev.select("tic", "sector", "event_id", "event_time", "phase", "duration", "period"),
                                spread=["cadence_id"])
    return pairs.select("event_id", "cadence_id",
                        views.cycle_from_phase(F.col("time")).alias("cycle"),
                        views.centred_cycle(F.col("time")).alias("centred_cycle"))


@query("w9_dip_runs", """
WITH b AS (SELECT *, flux < 0.995e0 AS below FROM lc),
s AS (SELECT *, CASE WHEN below AND NOT coalesce(lag(below) OVER (PARTITION BY tic, sector ORDER BY time), false)
   THEN 1 ELSE 0 END AS st FROM b),
r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY tic, sector ORDER BY time) AS BIGINT) AS run_id FROM s)
SELECT tic, sector, run_id, arg_min(time, (flux, time)) AS time, min(flux) AS flux, count(*) AS n_cadences
FROM r WHERE below GROUP BY tic, sector, run_id""", "time flux")
def w9(v):
    return gaps.dip_runs(v.lc.select("tic", "sector", "time", "flux"), 0.995)
