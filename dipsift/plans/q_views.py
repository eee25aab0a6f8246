"""Queries: event windows, fold-and-stack views, partners, matching (J*, A1-A5, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit
from dipsift.operators import census, hosts, incumbent, matching, noise, pairs, record, views
from dipsift.operators.rank import quantiles
from dipsift.plans.q_clean import CIRC, EDGES_SQL, ORBIT_SQL
from dipsift.plans.registry import query

EV = ["tic", "sector", "event_id", "event_time", "phase", "depth", "duration", "period"]


def hosted(v):
    return hosts.lookup(v.tce, v.ephemeris, ["event_id"])


def cadences(v):
    return v.lc.select("tic", "sector", "time", "flux", "flux_err", "phase", F.col("event_id").alias("cadence_id"))


def local_pairs(v):
    return views.event_windows(cadences(v).drop("phase"), v.tce.select("tic", "sector", "event_id", "event_time",
                                                         "depth", "duration"), ["cadence_id"])


LOCAL_SQL = """lp AS (SELECT t.event_id, t.event_time, t.depth, t.duration, l.time, l.flux, l.flux_err,
    l.event_id AS cadence_id, greatest(3e0 * t.duration, 0.75e0) AS half
  FROM tce t JOIN lc l ON l.tic = t.tic AND l.sector = t.sector
   AND abs(l.time - t.event_time) <= greatest(3e0 * t.duration, 0.75e0)),
lo AS (SELECT event_id, median(flux) FILTER (WHERE abs(time - event_time) > duration) AS med,
    count(*) FILTER (WHERE abs(time - event_time) > duration) AS n_oot, stddev_pop(flux) AS sd
  FROM lp GROUP BY event_id),
lm AS (SELECT lp.event_id, 1.4826e0 * median(abs(flux - med)) FILTER (WHERE abs(time - event_time) > duration) AS mad
  FROM lp JOIN lo ON lo.event_id = lp.event_id GROUP BY lp.event_id),
scatter AS (SELECT event_id, CASE WHEN raw > 0 THEN raw ELSE 1e-6 END AS local_scatter FROM (
  SELECT lo.event_id, CASE WHEN n_oot > 5 THEN mad ELSE sd END AS raw
  FROM lo JOIN lm ON lm.event_id = lo.event_id))"""


@query("j1_host_lookup", """
SELECT CASE WHEN h.tic IS NULL THEN 0 ELSE 1 END AS host_found, count(*) AS n_events,
   count(h.tmag) AS n_tmag FROM tce t LEFT JOIN (SELECT * FROM host WHERE sec_width IS NOT NULL) h
  ON h.tic = t.tic GROUP BY ALL""")
def j1(v):
    return hosts.lookup(v.tce, v.host.where(F.col("sec_width").isNotNull()), ["event_id"]).groupBy(
        "host_found").agg(F.count(lit(1)).alias("n_events"), F.count("tmag").alias("n_tmag"))


@query("j2_event_windows", f"WITH {LOCAL_SQL} SELECT event_id, cadence_id, time - event_time AS rel, flux FROM lp",
       "rel flux")
def j2(v):
    return local_pairs(v).select("event_id", "cadence_id", (F.col("time") - F.col("event_time")).alias("rel"), "flux")


@query("a1_local_scatter", f"WITH {LOCAL_SQL} SELECT event_id, local_scatter FROM scatter", "local_scatter", 9)
def a1(v):
    return views.local_scatter(local_pairs(v), ["event_id"])


@query("a2_local_view", f"""WITH {LOCAL_SQL}
SELECT event_id, CAST(least(greatest(floor((time - event_time + half) / (half + half) * 201e0), 0), 200) AS INTEGER) AS bin,
  median(flux) - 1e0 AS value, 1e0 AS valid FROM lp GROUP BY ALL""", "value valid")
def a2(v):
    return views.local_bins(local_pairs(v), ["event_id"])


def fold(v, capped=None):
    return views.fold_pairs(cadences(v), hosted(v).select("tic", "event_id", "event_time", "phase", "depth",
                                                          "duration", "period"), ["cadence_id"], capped)


def stack(v, capped=None):
    return views.stacked(fold(v, capped), views.local_scatter(local_pairs(v), ["event_id"]), ["event_id"])


def fold_sql(cap: str = "") -> str:
    return f"""fa AS (SELECT t.event_id, t.event_time, t.phase AS ev_phase, t.depth, t.duration, h.period,
    l.event_id AS cadence_id, l.flux, l.time,
    (l.phase - t.phase + 0.5e0) - floor(l.phase - t.phase + 0.5e0) - 0.5e0 AS dphi,
    floor((l.time - (t.event_time - t.phase * h.period)) / h.period) AS cycle
  FROM tce t JOIN host h ON h.tic = t.tic JOIN lc l ON l.tic = t.tic),
fb AS (SELECT *, abs(dphi) <= 1.5e0 * duration / period AS in_window,
    abs(dphi) * period > 1.5e0 * duration AND abs(dphi) * period <= 3e0 * duration AS in_sideband FROM fa),
fp AS (SELECT * FROM fb WHERE (in_window OR in_sideband) AND cycle <> floor(ev_phase){cap}),
fc AS (SELECT event_id, cycle, CASE WHEN count(*) FILTER (WHERE in_sideband) >= 5
      THEN median(flux) FILTER (WHERE in_sideband) ELSE median(flux) FILTER (WHERE in_window) END AS continuum
  FROM fp GROUP BY event_id, cycle HAVING count(*) FILTER (WHERE in_window) > 0),
fs AS (SELECT fp.*, flux / continuum AS level, greatest(depth, 3e0 * local_scatter) AS denom, local_scatter
  FROM fp JOIN fc ON fc.event_id = fp.event_id AND fc.cycle = fp.cycle
  JOIN scatter s ON s.event_id = fp.event_id WHERE in_window AND continuum <> 0),
fd AS (SELECT event_id, cycle, max((1e0 - level) / denom) AS d, any_value(3e0 * local_scatter / denom) AS thr
  FROM fs GROUP BY event_id, cycle),
fm AS (SELECT event_id, median(d) AS rec_depth_med, avg(CASE WHEN d > thr THEN 1e0 ELSE 0e0 END) AS rec_frac_dipping,
    count(*) AS n_cycles_raw FROM fd GROUP BY event_id),
recur AS (SELECT fm.*, (SELECT 1.4826e0 * median(abs(d - rec_depth_med)) FROM fd WHERE fd.event_id = fm.event_id)
    AS rec_depth_mad FROM fm)"""


FOLD_SQL = fold_sql()


@query("j3_fold_join", f"""WITH {LOCAL_SQL}, {FOLD_SQL}
SELECT event_id, CAST(cycle AS BIGINT) AS cycle, count(*) FILTER (WHERE in_window) AS n_window, count(*) FILTER (WHERE in_sideband) AS n_sideband,
  sum(dphi) AS dphi_sum, sum(flux) AS flux_sum FROM fp GROUP BY event_id, cycle""", "dphi_sum flux_sum")
def j3(v):
    """The pairs of the fold, counted and summed per event and cycle."""
    return fold(v).groupBy("event_id", "cycle").agg(
        F.count_if("in_window").alias("n_window"), F.count_if("in_sideband").alias("n_sideband"),
        F.sum("dphi").alias("dphi_sum"), F.sum("flux").alias("flux_sum"))


@query("a3_recurrence_view", f"""WITH {LOCAL_SQL}, {FOLD_SQL}
SELECT event_id, CAST(least(greatest(floor((dphi + 1.5e0 * duration / period)
     / (1.5e0 * duration / period + 1.5e0 * duration / period) * 64e0), 0), 63) AS INTEGER) AS bin,
  median(level - 1e0) / any_value(denom) AS value, ln(1e0 + least(count(DISTINCT cycle), 60)) AS cycles
FROM fs GROUP BY ALL""", "value cycles")
def a3(v):
    return views.recurrence_bins(stack(v), ["event_id"])


@query("a4_recurrence_scalars", f"WITH {LOCAL_SQL}, {FOLD_SQL} SELECT * FROM recur",
       "rec_depth_med rec_depth_mad rec_frac_dipping")
def a4(v):
    return views.recurrence_scalars(stack(v), ["event_id"])


PARTNER_SQL = """pp AS (SELECT a.event_id, abs(b.event_time - a.event_time) AS dt, b.event_time AS other_time,
    least(a.duration, b.duration) / greatest(a.duration, b.duration) AS ratio, b.depth AS other_depth
  FROM tce a JOIN host h ON h.tic = a.tic JOIN tce b ON b.tic = a.tic
   AND abs(b.event_time - a.event_time) > 1e-9
   AND abs(b.event_time - a.event_time) >= greatest(0.15e0, a.duration)
   AND abs(b.event_time - a.event_time) <= 0.5e0 * h.period),
partner AS (SELECT event_id, count(*) AS n_candidates, min(dt) AS partner_dt, arg_min(ratio, (dt, other_time)) AS pair_duration_ratio,
    arg_min(other_depth, (dt, other_time)) AS partner_depth FROM pp GROUP BY event_id)"""


@query("j4_nearest_partner", f"""WITH {PARTNER_SQL}
SELECT t.event_id, coalesce(n_candidates, 0) AS n_candidates, partner_dt, pair_duration_ratio, partner_depth
FROM tce t LEFT JOIN partner p ON p.event_id = t.event_id""", "partner_dt pair_duration_ratio partner_depth")
def j4(v):
    return pairs.nearest_partner(hosted(v).select(*EV), ["tic"]).select(
        "event_id", "n_candidates", "partner_dt", "pair_duration_ratio", "partner_depth")


@query("j4_nearest_partner_by_test", """
WITH e AS (SELECT x.*, h.period FROM test_events x JOIN host h ON h.tic = x.tic),
pp AS (SELECT a.event_id, abs(b.event_time - a.event_time) AS dt, b.event_time AS ot,
    least(a.duration, b.duration) / greatest(a.duration, b.duration) AS ratio
  FROM e a JOIN e b ON b.model_idx = a.model_idx AND abs(b.event_time - a.event_time) > 1e-9
   AND abs(b.event_time - a.event_time) BETWEEN greatest(0.15e0, a.duration) AND 0.5e0 * a.period)
SELECT e.event_id, count(pp.dt) AS n_candidates, min(pp.dt) AS partner_dt, arg_min(ratio, (dt, ot)) AS pair_duration_ratio
FROM e LEFT JOIN pp ON pp.event_id = e.event_id GROUP BY e.event_id""", "partner_dt pair_duration_ratio")
def j4_tests(v):
    ev = hosts.lookup(v.test_events, v.ephemeris, ["event_id"])
    return pairs.nearest_partner(ev, ["tic", "sector", "model_idx"]).select(
        "event_id", "n_candidates", "partner_dt", "pair_duration_ratio")


RECOVERY_SQL = """lab AS (SELECT e.*, CASE WHEN abs(e.event_time - t.inj_time) < t.inj_duration / 2e0 THEN 1 ELSE 0 END AS is_lead,
    CASE WHEN abs(e.event_time - t.partner_time) < t.inj_duration / 2e0 THEN 1 ELSE 0 END AS is_partner,
    t.partner_time IS NOT NULL AS paired
  FROM test_events e JOIN tests t ON t.model_idx = e.model_idx),
recov AS (SELECT t.*, coalesce(r.a, 0) AS recovered, coalesce(r.b, 0) AS recovered_partner, coalesce(r.n, 0) AS n_events_flagged
  FROM tests t LEFT JOIN (SELECT model_idx, max(is_lead) AS a, max(is_partner) AS b, count(*) AS n FROM lab GROUP BY model_idx) r
   ON r.model_idx = t.model_idx)"""


def labelled(v):
    return matching.recovery_labels(v.test_events, v.tests, ["model_idx"], ["event_id"])


def recovered_tests(v):
    return matching.recovery_by_test(v.tests, labelled(v), ["model_idx"])


@query("j5_recovery_labels", f"""WITH {RECOVERY_SQL}
SELECT event_id, is_lead, is_partner, greatest(is_lead, is_partner) AS label,
  CASE WHEN is_lead = 1 AND paired THEN 'lead' WHEN is_partner = 1 THEN 'partner' ELSE 'none' END AS pair_role FROM lab""")
def j5(v):
    return labelled(v).select("event_id", "is_lead", "is_partner", "label", "pair_role")


@query("j5_recovery_by_test", f"""WITH {RECOVERY_SQL}
SELECT model_idx, recovered, recovered_partner, recovered * recovered_partner AS recovered_pair, n_events_flagged FROM recov""")
def j5_tests(v):
    return recovered_tests(v).select("model_idx", "recovered", "recovered_partner", "recovered_pair", "n_events_flagged")


@query("j6_first_listed_transit", """
WITH tr AS (SELECT model_idx, 0 AS pos, inj_time AS t_transit, inj_duration AS d FROM tests
  UNION ALL SELECT model_idx, 1, partner_time, inj_duration * 0.5e0 FROM tests WHERE partner_time IS NOT NULL),
m AS (SELECT e.event_id, min(tr.pos) AS pos FROM test_events e JOIN tr ON tr.model_idx = e.model_idx
   AND abs(e.event_time - tr.t_transit) < greatest(tr.d, 2e0 * (30e0 / 1440e0)) / 2e0 GROUP BY e.event_id)
SELECT e.event_id, m.pos, CASE WHEN m.pos IS NULL THEN 0 ELSE 1 END AS label
FROM test_events e LEFT JOIN m ON m.event_id = e.event_id""")
def j6(v):
    lead = v.tests.select("model_idx", lit(0).cast("int").alias("pos"), F.col("inj_time").alias("t_transit"),
                          F.col("inj_duration").alias("transit_duration"))
    partner = v.tests.where(F.col("partner_time").isNotNull()).select(
        "model_idx", lit(1).cast("int").alias("pos"), F.col("partner_time").alias("t_transit"),
        (F.col("inj_duration") * lit(0.5)).alias("transit_duration"))
    return matching.first_listed_transit(v.test_events, lead.unionByName(partner), ["model_idx"],
                                         ["event_id"], "event_id", "pos").select("event_id", "pos", "label")


KNOWN_SQL = """kn AS (SELECT * FROM known WHERE in_window LIKE 'yes%'),
km AS (SELECT DISTINCT t.event_id, k.known_id FROM tce t JOIN kn k ON k.tic = t.tic
   AND abs(t.event_time - k.t_known) <= greatest(t.duration / 2e0, k.t_unc))"""


def in_window(v):
    return v.known.where(F.col("in_window").startswith("yes"))


@query("j7_known_time_match", f"""WITH {KNOWN_SQL}
SELECT tic, max(n_events) AS n_flagged, max(d1) AS d1, max(d2) AS d2, max(nm) AS n_times_matched FROM (
 SELECT tic, count(*) AS n_events, count(*) FILTER (WHERE event_id IN (SELECT event_id FROM km)) AS d1, 0 AS d2, 0 AS nm
   FROM tce GROUP BY tic
 UNION ALL SELECT tic, 0, 0, count(*), count(*) FILTER (WHERE known_id IN (SELECT known_id FROM km)) FROM kn GROUP BY tic)
GROUP BY tic""")
def j7(v):
    ev, kn = matching.matched_to_known(v.tce.select("tic", "event_id", "event_time", "duration"),
                                       in_window(v).select("tic", "known_id", "t_known", "t_unc"))
    zero = F.lit(0).cast("bigint")
    a = ev.groupBy("tic").agg(F.count(lit(1)).alias("n_flagged"), F.sum("matched").alias("d1")).select(
        "tic", "n_flagged", "d1", zero.alias("d2"), zero.alias("n_times_matched"))
    b = kn.groupBy("tic").agg(F.count(lit(1)).alias("d2"), F.sum("matched").alias("n_times_matched")).select(
        "tic", zero.alias("n_flagged"), zero.alias("d1"), "d2", "n_times_matched")
    return a.unionByName(b).groupBy("tic").agg(*[F.max(c).alias(c) for c in
                                                 ("n_flagged", "d1", "d2", "n_times_matched")])


@query("j7_reference_recovery", """
SELECT k.known_id, CASE WHEN EXISTS (SELECT 1 FROM tce t WHERE t.tic = k.tic AND t.snr >= 8e0
   AND abs(t.event_time - k.t_known) < greatest(0.15e0, t.duration / 2e0)) THEN 1 ELSE 0 END AS recovered
FROM known k""")
def j7_reference(v):
    return matching.recovers_reference(v.tce, v.known.select("tic", "known_id", "t_known")).select(
        "known_id", "recovered")


@query("j8_blocked_cadences", """
SELECT l.tic, l.sector, count(*) AS n_cadences, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM tce t
   WHERE t.tic = l.tic AND t.sector = l.sector
     AND abs(l.time - t.event_time) < t.duration / 2e0 + 0.2e0 / 2e0 + 30e0 / 1440e0)) AS n_blocked
FROM lc l GROUP BY l.tic, l.sector""")
def j8(v):
    half = F.col("duration") / lit(2) + lit(0.2) / lit(2) + lit(k.CADENCE_DAYS)
    spans = v.tce.select("tic", "sector", (F.col("event_time") - half).alias("_a"),
                         (F.col("event_time") + half).alias("_z"))
    return pairs.covered(v.lc.select("tic", "sector", "time"), spans, ["tic", "sector"], "time", "_a", "_z") \
        .groupBy("tic", "sector").agg(F.count(lit(1)).alias("n_cadences"), F.count_if(F.col("covered") == 1).alias("n_blocked"))


@query("j9_on_data", """
SELECT model_idx FROM tests t WHERE EXISTS (SELECT 1 FROM lc l WHERE l.tic = t.tic AND l.sector = t.sector
   AND abs(l.time - t.inj_time) < 30e0 / 1440e0)""")
def j9(v):
    q = v.tests.select("tic", "sector", "model_idx", F.col("inj_time").alias("time"))
    return pairs.within_cadence(v.lc.select("tic", "sector", "time"), q, ["tic", "sector"], "time").select("model_idx")


@query("j10_curve_reconciliation", """
WITH a AS (SELECT * FROM lc WHERE event_type IN ('view', 'click')), b AS (SELECT * FROM lc WHERE event_type NOT IN ('view', 'click')),
n AS (SELECT a.tic, a.sector, a.event_id, a.time, a.flux,
   coalesce((SELECT min(b.time) FROM b WHERE b.tic = a.tic AND b.sector = a.sector AND b.time >= a.time),
            (SELECT max(b.time) FROM b WHERE b.tic = a.tic AND b.sector = a.sector AND b.time < a.time)) AS bt FROM a),
d AS (SELECT abs(b.flux - n.flux) AS df FROM n JOIN b ON b.tic = n.tic AND b.sector = n.sector AND b.time = n.bt
   WHERE abs(n.bt - n.time) < 0.2e0)
SELECT count(*) AS n_matched, median(df) AS median_diff, quantile_cont(df, 0.95) AS p95_diff FROM d""",
       "median_diff p95_diff")
def j10(v):
    shown = F.col("event_type").isin("view", "click")
    cols = ["tic", "sector", "time", "flux"]
    near = pairs.next_sample(v.lc.where(shown).select(*cols), v.lc.where(~shown).select(*cols),
                             ["tic", "sector"], "time", "flux")
    diff = near.where(F.col("dt") < lit(0.2)).withColumn("df", F.abs(F.col("other_value") - F.col("flux")))
    return quantiles(diff, [], "df", {"median_diff": 0.5, "p95_diff": 0.95}).withColumnRenamed("n", "n_matched")


INCUMBENT_SQL = """repeated AS (SELECT *, 1 AS ingest FROM comparator UNION ALL
  SELECT * REPLACE ('T' AS best_fit, -1e0 AS aic_transit), 2 FROM comparator WHERE filename % 4 = 1), """ \
    + "inc AS (SELECT r.rec_id AS filename, CASE WHEN c.filename IS NULL THEN 0 ELSE 1 END AS incumbent_valid, " + \
    ", ".join([f"coalesce(c.{a} - least({', '.join('c.' + x for x in k.AIC_COLUMNS)}), 0e0) AS delta_{a}" for a in k.AIC_COLUMNS]
              + [f"coalesce(c.{a}, 0e0) AS {a}" for a in k.RMSE_COLUMNS]
              + [f"CASE WHEN c.best_fit = '{b}' THEN 1e0 ELSE 0e0 END AS best_fit_{b}" for b in k.BEST_FIT_CLASSES]) + \
    " FROM record r LEFT JOIN (SELECT * FROM repeated QUALIFY row_number() OVER (PARTITION BY filename ORDER BY ingest) = 1) c ON c.filename = r.rec_id)"


@query("j11_incumbent_block", f"WITH {INCUMBENT_SQL} SELECT * FROM inc", " ".join(k.INCUMBENT_COLUMNS))
def j11(v):
    keys = v.record.select(F.col("rec_id").alias("filename"))
    return incumbent.incumbent_block(keys, repeated(v), "ingest")


def repeated(v):
    """Comparator rows in ingest order; some keys come again with other values."""
    again = v.comparator.where(F.col("filename") % 4 == 1).withColumns({"best_fit": F.lit("T"), "aic_transit": lit(-1)})
    return v.comparator.withColumn("ingest", F.lit(1)).unionByName(again.withColumn("ingest", F.lit(2)))


@query("p12_event_scalars", """
SELECT t.event_id, log10(h.period) AS log_p_bin, sin(6.283185307179586e0 * t.phase) AS sin_phase,
  cos(6.283185307179586e0 * t.phase) AS cos_phase, t.n_detrend_detections / 21e0 AS detrend_fraction,
  ln(1e0 + least(t.event_id % 80, 60)) AS log1p_n_cycles, greatest(t.depth, 3e0 * 0.004e0) AS denom,
  greatest(3e0 * t.duration, 0.75e0) AS half FROM tce t JOIN host h ON h.tic = t.tic""",
       "log_p_bin sin_phase cos_phase detrend_fraction log1p_n_cycles denom half")
def p12(v):
    from dipsift.functions.expr import depth_floor, local_half
    ev = hosted(v).withColumn("n_cycles_raw", F.col("event_id") % 80)
    return incumbent.event_scalars(ev).select(
        "event_id", "log_p_bin", "sin_phase", "cos_phase", "detrend_fraction", "log1p_n_cycles",
        depth_floor(F.col("depth"), lit(0.004)).alias("denom"), local_half(F.col("duration")).alias("half"))


RECORD_SQL = ORBIT_SQL.rstrip() + f""", {EDGES_SQL}, {LOCAL_SQL}, {FOLD_SQL}, {PARTNER_SQL},
gp AS (SELECT t.event_id, min(abs(e.time - t.event_time)) AS gap_proximity
  FROM tce t LEFT JOIN (SELECT * FROM edges SEMI JOIN sized USING (tic, sector)) e
    ON e.tic = t.tic AND e.sector = t.sector GROUP BY t.event_id)
SELECT t.event_id, t.snr, t.depth, t.duration AS t_dur, log10(o.period) AS log_p_bin, o.tmag, o.morph_coeff,
  CASE WHEN t.event_id % 5 <> 0 THEN t.skye_flag END AS skye_flag, gp.gap_proximity, s.local_scatter, coalesce(r.n_cycles_raw, 0) AS n_cycles_raw,
  ln(1e0 + least(coalesce(r.n_cycles_raw, 0), 60)) AS log1p_n_cycles, coalesce(r.rec_depth_med, 0e0) AS rec_depth_med,
  coalesce(r.rec_depth_mad, 0e0) AS rec_depth_mad, coalesce(r.rec_frac_dipping, 0e0) AS rec_frac_dipping,
  CASE WHEN o.p_crit > o.period * pow(1e0 / 0.3e0 + 1e0, 3) THEN 1e0 ELSE 0e0 END AS same_star_multi_allowed,
  log10(o.p_crit / o.period) AS log10_pp_over_pbin, CASE WHEN p.event_id IS NULL THEN 0e0 ELSE 1e0 END AS has_observed_pair,
  p.partner_dt / o.period AS pair_dt_over_pbin, p.pair_duration_ratio,
  CASE WHEN o.sec_depth / o.prim_depth > 0 AND p.partner_depth IS NOT NULL
    THEN log10(greatest(p.partner_depth / t.depth, 1e-6) / (o.sec_depth / o.prim_depth)) END AS pairing_depth_ratio_vs_expectation,
  CASE WHEN t.skye_flag IS NULL OR t.event_id % 5 = 0 THEN 0 ELSE 1 END AS valid_skye_flag, CASE WHEN o.tmag IS NULL THEN 0 ELSE 1 END AS valid_tmag,
  CASE WHEN p.event_id IS NULL THEN 0 ELSE 1 END AS valid_pair_duration_ratio
FROM tce t JOIN o ON o.tic = t.tic JOIN gp ON gp.event_id = t.event_id JOIN scatter s ON s.event_id = t.event_id
LEFT JOIN recur r ON r.event_id = t.event_id LEFT JOIN partner p ON p.event_id = t.event_id"""
RECORD_COLUMNS = ["event_id", "snr", "depth", "t_dur", "log_p_bin", "tmag", "morph_coeff", "skye_flag", "gap_proximity",
                  "local_scatter", "n_cycles_raw", "log1p_n_cycles", "rec_depth_med", "rec_depth_mad", "rec_frac_dipping",
                  "same_star_multi_allowed", "log10_pp_over_pbin", "has_observed_pair", "pair_dt_over_pbin",
                  "pair_duration_ratio", "pairing_depth_ratio_vs_expectation", "valid_skye_flag", "valid_tmag",
                  "valid_pair_duration_ratio"]


def records(v):
    noise_table = v.host.select("tic", (F.col("sec_depth") / F.col("prim_depth")).alias("depth_ratio"))
    return record.build_scalars(v.lc, v.tce, hosts.host_table(v.host, noise_table), cadence_key="event_id",
                                real_search=F.col("event_id") % 5 != 0)


@query("p15_record_scalars", RECORD_SQL, " ".join(c for c in RECORD_COLUMNS if c not in (
    "event_id", "n_cycles_raw", "skye_flag") and not c.startswith("valid_")), 7)
def p15(v):
    return records(v).select(*RECORD_COLUMNS)


A13_SQL = """fd AS (SELECT c.model, c.event_id, c.egress - c.ingress AS dur,
    count(*) FILTER (WHERE abs(l.time - c.time) <= greatest(c.egress - c.ingress, 1e-3) / 2e0) AS n_in,
    min(l.flux) FILTER (WHERE abs(l.time - c.time) <= greatest(c.egress - c.ingress, 1e-3) / 2e0) AS lo,
    count(*) FILTER (WHERE abs(l.time - c.time) > greatest(c.egress - c.ingress, 1e-3)) AS n_near,
    median(l.flux) FILTER (WHERE abs(l.time - c.time) > greatest(c.egress - c.ingress, 1e-3)) AS cont
  FROM crossings c JOIN lc l ON l.tic = c.model AND abs(l.time - c.time) <= 3e0 * greatest(c.egress - c.ingress, 1e-3)
  GROUP BY ALL),
depths AS (SELECT model, event_id, 1e0 - lo / cont AS crossing_depth FROM fd
  WHERE n_in >= 1 AND n_near >= 2 AND cont > 0 AND 1e0 - lo / cont > 0 AND 1e0 - lo / cont <= 0.05e0)"""


@query("a13_crossing_depth", f"WITH {A13_SQL} SELECT event_id, crossing_depth FROM depths", "crossing_depth")
def a13(v):
    return census.crossing_depths(v.lc, v.crossings, min_inside=1, min_near=2).select("event_id", "crossing_depth")


@query("j17_cross_star_pairs", """
WITH c AS (SELECT * FROM crossings WHERE abs(impact) < 1e0 AND egress - ingress >= 1e-4 AND body >= 3),
g AS (SELECT model, cycle, count(*) AS n_events, count(DISTINCT star) AS n_stars, median(egress - ingress) AS dur,
    max(period) AS period, arg_min(depth, time) FILTER (WHERE star = 1) AS d1, arg_min(depth, time) FILTER (WHERE star = 2) AS d2,
    CASE WHEN greatest(count(*) FILTER (WHERE star = 1), count(*) FILTER (WHERE star = 2)) >= 2 THEN 1 ELSE 0 END AS same_star_multiple
  FROM c GROUP BY model, cycle),
x AS (SELECT a.model, a.cycle, min(abs(a.time - b.time)) AS dt FROM c a JOIN c b ON b.model = a.model AND b.cycle = a.cycle
   AND a.star = 1 AND b.star = 2 GROUP BY a.model, a.cycle),
p AS (SELECT g.*, x.dt, CASE WHEN coalesce(0.5e0 * period > greatest(0.15e0, dur) AND dt >= greatest(0.15e0, dur)
   AND dt <= 0.5e0 * period, false) THEN 1 ELSE 0 END AS is_pair FROM g LEFT JOIN x ON x.model = g.model AND x.cycle = g.cycle)
SELECT model, cycle, n_events, n_stars, same_star_multiple, dt, is_pair, CASE WHEN is_pair = 1 THEN dt / period END AS dt_over_pbin,
  CASE WHEN is_pair = 1 AND d1 > 0 THEN d2 / d1 END AS depth_ratio_seen FROM p""", "dt dt_over_pbin depth_ratio_seen")
def j17(v):
    return census.conjunctions(v.crossings).select(
        "model", "cycle", "n_events", "n_stars", "same_star_multiple", "dt", "is_pair", "dt_over_pbin", "depth_ratio_seen")


A5_SQL = f"""ooe AS (SELECT l.tic, l.sector, l.time, l.flux FROM lc l JOIN host h ON h.tic = l.tic
  WHERE {CIRC.format('l.phase', 'h.prim_pos')} > 1.6e0 * h.prim_width
    AND {CIRC.format('l.phase', 'h.sec_pos')} > 1.6e0 * coalesce(h.sec_width, 2e-2)),
big AS (SELECT tic, sector, median(flux) AS med FROM ooe GROUP BY tic, sector HAVING count(*) >= 5 AND median(flux) > 0),
ch AS (SELECT *, sum(CASE WHEN time - p > 0.75e0 THEN 1 ELSE 0 END) OVER (PARTITION BY tic, sector ORDER BY time) AS chunk
  FROM (SELECT ooe.*, big.med, lag(time) OVER (PARTITION BY ooe.tic, ooe.sector ORDER BY time) AS p
        FROM ooe JOIN big ON big.tic = ooe.tic AND big.sector = ooe.sector)),
mu AS (SELECT *, avg(time) OVER (PARTITION BY tic, sector, chunk) AS tm, count(*) OVER (PARTITION BY tic, sector, chunk) AS nc FROM ch),
pw AS (SELECT *, time - tm AS x FROM mu WHERE nc >= 4),
sm AS (SELECT tic, sector, chunk, count(*) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4,
    sum(flux) AS y0, sum(x*flux) AS y1, sum(x*x*flux) AS y2 FROM pw GROUP BY tic, sector, chunk),
dt AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM sm),
cf AS (SELECT tic, sector, chunk,
    (y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2)) / det AS c0,
    (s0*(y1*s4-y2*s3) - y0*(s1*s4-s2*s3) + s2*(s1*y2-s2*y1)) / det AS c1,
    (s0*(s2*y2-s3*y1) - s1*(s1*y2-s2*y1) + y0*(s1*s3-s2*s2)) / det AS c2 FROM dt WHERE det > 1e-9),
rs AS (SELECT pw.tic, pw.sector, (flux - (c0 + c1*x + c2*x*x)) / med AS res FROM pw JOIN cf
   ON cf.tic = pw.tic AND cf.sector = pw.sector AND cf.chunk = pw.chunk),
rm AS (SELECT tic, sector, median(res) AS m FROM rs GROUP BY tic, sector),
fr AS (SELECT rs.tic, rs.sector, 1.4826e0 * median(abs(res - m)) AS rms FROM rs JOIN rm ON rm.tic = rs.tic AND rm.sector = rs.sector
   GROUP BY rs.tic, rs.sector)
"""


@query("a5_noise_screen", f"WITH {A5_SQL.rstrip()} SELECT fr.tic, count(*) AS n_files, median(rms) AS rms_cadence, "
       "any_value(h.sec_depth / h.prim_depth) AS depth_ratio FROM fr JOIN host h ON h.tic = fr.tic GROUP BY fr.tic",
       "rms_cadence depth_ratio", 7)
def a5(v):
    return noise.noise_screen(v.lc, v.host, min_points=5, min_chunk=4).select("tic", "n_files", "rms_cadence", "depth_ratio")
