"""Queries: evaluation, rollups, histograms, ranks (A6-A33, K*, W8)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions import expr
from dipsift.functions.expr import lit, uniform
from dipsift.operators import census, evaluate, gaps, hosts, matching, queue, rank, split
from dipsift.plans.fixtures import u_sql
from dipsift.plans.q_clean import CIRC, EDGE_DISTANCE, EDGES_SQL, NOISE_SQL, ORBIT_SQL, eclipses, noise_view
from dipsift.plans.q_views import KNOWN_SQL, RECOVERY_SQL, in_window, recovered_tests
from dipsift.plans.registry import query

ARMS = {"b0": "score_base", "b": "score"}
TAU = 0.6


@query("a6_joint_histogram", f"""WITH {EDGES_SQL},
f AS (SELECT t.* FROM tce t WHERE snr >= 5e0 AND duration <= 1e0 AND det_dependence = 0 AND coalesce(skye_flag, 0) = 0),
g AS (SELECT t.event_id, {EDGE_DISTANCE} AS d_phi,
   (SELECT min(abs(e.time - t.event_time)) FROM edges e SEMI JOIN sized USING (tic, sector) WHERE e.tic = t.tic AND e.sector = t.sector) AS d_gap
  FROM f t JOIN host h ON h.tic = t.tic),
b AS (SELECT CAST(least(floor(d_phi / 0.5e0 * 10e0), 9) AS INTEGER) AS phase_bin,
   CASE WHEN d_gap < 0.1 THEN 0 WHEN d_gap < 0.25 THEN 1 WHEN d_gap < 0.5 THEN 2 WHEN d_gap < 1 THEN 3
        WHEN d_gap < 2 THEN 4 WHEN d_gap < 4 THEN 5 WHEN d_gap < 8 THEN 6 ELSE 7 END AS gap_bin
  FROM g WHERE d_phi BETWEEN 0e0 AND 0.5e0 AND d_gap BETWEEN 0e0 AND 30e0)
SELECT p.i AS phase_bin, q.i AS gap_bin, count(b.phase_bin) AS n
FROM (SELECT unnest(range(10)) AS i) p CROSS JOIN (SELECT unnest(range(8)) AS i) q
LEFT JOIN b ON b.phase_bin = p.i AND b.gap_bin = q.i GROUP BY ALL""")
def a6(v):
    return evaluate.joint_histogram(histogram_rows(v), "d_phi", "d_gap")


def histogram_rows(v):
    kept = v.tce.where((F.col("snr") >= lit(k.MIN_SNR)) & (F.col("duration") <= lit(k.MAX_DURATION_DAYS))
                       & (F.col("det_dependence") == 0) & (F.coalesce("skye_flag", lit(0)) == 0))
    ev = gaps.gap_distance(v.lc, kept.select("tic", "sector", "event_id", "event_time", "phase"), "event_time", name="d_gap")
    return hosts.lookup(ev, v.host.select("tic", "prim_pos", "prim_width", "sec_pos", "sec_width"), ["event_id"]) \
        .withColumn("d_phi", expr.eclipse_edge_distance(F.col("phase"), *eclipses()))


SYSTEM_SQL = """sys0 AS (SELECT r.tic, count(*) AS n_events, CAST(sum(label) AS BIGINT) AS n_positive, max(n_cycles_raw) AS n_cycles,
   any_value(h.period) AS period, any_value(h.tmag) AS tmag FROM record r LEFT JOIN host h ON h.tic = r.tic GROUP BY r.tic),
cuts AS (SELECT quantile_cont(period, 1e0/3e0) AS pa, quantile_cont(period, 2e0/3e0) AS pb,
   quantile_cont(tmag, 1e0/3e0) AS ta, quantile_cont(tmag, 2e0/3e0) AS tb FROM sys0),
systems AS (SELECT sys0.*, CASE WHEN n_cycles < 3 THEN 'lt3' WHEN n_cycles < 10 THEN '3to9' ELSE '10plus' END AS coverage,
   CASE WHEN period IS NULL THEN 'unknown' WHEN period <= pa THEN 'lo' WHEN period <= pb THEN 'mid' ELSE 'hi' END AS period_tercile,
   CASE WHEN tmag IS NULL THEN 'unknown' WHEN tmag <= ta THEN 'lo' WHEN tmag <= tb THEN 'mid' ELSE 'hi' END AS tmag_tercile
  FROM sys0, cuts),
sysx AS (SELECT *, coverage || '|' || period_tercile || '|' || tmag_tercile AS stratum FROM systems)"""


@query("a7_system_table", f"WITH {SYSTEM_SQL} SELECT tic, n_events, n_positive, n_cycles, coverage, stratum FROM sysx")
def a7(v):
    return split.system_table(v.record, v.host).select("tic", "n_events", "n_positive", "n_cycles", "coverage", "stratum")


@query("a8_class_balance_probe", """
SELECT *, abs(positive_rate - negative_rate) AS value, CASE WHEN abs(positive_rate - negative_rate) <= 0.05e0 THEN 1 ELSE 0 END AS passed,
  CASE WHEN 2e0 * standard_error > 0.05e0 THEN 1 ELSE 0 END AS underpowered FROM (
  SELECT avg(inverted) FILTER (WHERE label = 1) AS positive_rate, avg(inverted) FILTER (WHERE label = 0) AS negative_rate,
   count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg,
   sqrt(0.25e0 / count(*) FILTER (WHERE label = 1) + 0.25e0 / count(*) FILTER (WHERE label = 0)) AS standard_error FROM classes)
""", "positive_rate negative_rate standard_error value")
def a8(v):
    from dipsift.operators import probes
    return probes.inversion_balance(v.classes, "label", "inverted").drop("probe", "gate")


@query("a9_campaign_acceptance", f"""WITH {RECOVERY_SQL},
leads AS (SELECT DISTINCT model_idx FROM lab WHERE is_lead = 1 AND paired)
SELECT count(*) AS n_tests, avg(inverted_lc) AS inversion_rate, avg(recovered) AS recovery_rate,
  avg(partner_requested) AS pair_requested_rate, avg(recovered * recovered_partner) AS pair_recovered_rate,
  count(*) FILTER (WHERE partner_requested = 1 AND recovered = 0 AND recovered_partner = 1) AS partner_only,
  (SELECT count(*) FROM lab WHERE is_partner = 1 AND NOT (is_lead = 1 AND paired) AND model_idx NOT IN (SELECT model_idx FROM leads)) AS orphans,
  CASE WHEN abs(avg(inverted_lc) - 0.5e0) > 0.02e0 AND abs(avg(inverted_lc) - 0.5e0) > 2e0 * sqrt(0.25e0 / count(*)) THEN 1 ELSE 0 END AS mix_problem
FROM recov""", "inversion_rate recovery_rate pair_requested_rate pair_recovered_rate")
def a9(v):
    from dipsift.operators import campaign
    from dipsift.plans.q_views import labelled
    return campaign.acceptance(recovered_tests(v), labelled(v))


@query("a10_mix_gate", """
WITH x AS (SELECT program, inverted_lc FROM tests UNION ALL
  SELECT CASE WHEN program LIKE 'per_system%' THEN 'per_system*' WHEN program LIKE 'aggregate%' THEN 'aggregate*' ELSE 'secondary_all63*' END, inverted_lc FROM tests)
SELECT program, count(*) AS n, avg(inverted_lc) AS rate, CASE WHEN abs(avg(inverted_lc) - 0.5e0) <= 0.02e0 THEN 1 ELSE 0 END AS gate_pass
FROM x GROUP BY program""", "rate")
def a10(v):
    prefix = F.when(F.col("program").startswith("per_system"), "per_system*") \
        .when(F.col("program").startswith("aggregate"), "aggregate*").otherwise("secondary_all63*")
    rows = v.tests.select("inverted_lc", F.explode(F.array("program", prefix)).alias("program"))
    return evaluate.balance(rows, ["program"], "inverted_lc")


@query("a11_detected_pair_rate", f"""WITH {RECOVERY_SQL},
g AS (SELECT tic, sector, floor(inj_time) AS c, count(DISTINCT 1 + model_idx % 2) AS n, count(DISTINCT 1 + model_idx % 2) FILTER (WHERE recovered = 1) AS r
  FROM recov GROUP BY ALL)
SELECT count(*) FILTER (WHERE n >= 2) AS n_geometric, count(*) FILTER (WHERE n >= 2 AND r >= 2) AS n_detected,
  count(*) FILTER (WHERE n >= 2 AND r >= 2) / greatest(count(*) FILTER (WHERE n >= 2), 1)::DOUBLE AS detected_pair_rate FROM g""", "detected_pair_rate")
def a11(v):
    t = recovered_tests(v).withColumns({"star": 1 + F.col("model_idx") % 2, "cycle": F.floor("inj_time")})
    return census.detected_pair_rate(t, ["tic", "sector", "cycle"])


CONJ_SQL = """cc AS (SELECT * FROM crossings WHERE abs(impact) < 1e0 AND egress - ingress >= 1e-4 AND body >= 3),
cg AS (SELECT model, cycle, median(egress - ingress) AS dur, max(period) AS period, any_value(sigma_bin) AS sigma_bin,
    CASE WHEN greatest(count(*) FILTER (WHERE star = 1), count(*) FILTER (WHERE star = 2)) >= 2 THEN 1 ELSE 0 END AS same_star_multiple
  FROM cc GROUP BY model, cycle),
cx AS (SELECT a.model, a.cycle, min(abs(a.time - b.time)) AS dt FROM cc a JOIN cc b ON b.model = a.model AND b.cycle = a.cycle
   AND a.star = 1 AND b.star = 2 GROUP BY a.model, a.cycle),
conj AS (SELECT cg.*, cx.dt, CASE WHEN coalesce(0.5e0 * period > greatest(0.15e0, dur) AND dt BETWEEN greatest(0.15e0, dur) AND 0.5e0 * period, false)
   THEN 1 ELSE 0 END AS is_pair FROM cg LEFT JOIN cx ON cx.model = cg.model AND cx.cycle = cg.cycle)"""


@query("a12_conjunction_census", f"""WITH {CONJ_SQL}
SELECT sigma_bin, count(*) AS n_conjunctions, avg(is_pair) AS pair_rate, avg(same_star_multiple) AS same_star_rate
FROM conj GROUP BY ROLLUP (sigma_bin)""", "pair_rate same_star_rate")
def a12(v):
    conj = census.conjunctions(v.crossings).withColumn("sigma_bin", F.when(F.col("model") % 2 == 0, "tight").otherwise("loose"))
    return census.census_rates(conj)


@query("a14_quantile_fit", """
WITH g AS (SELECT price / 1e3 AS g FROM record WHERE price > 0), c AS (SELECT quantile_cont(g, 0.99) AS cap FROM g),
w AS (SELECT least(g, cap) AS g, CASE WHEN g > cap THEN 1 ELSE 0 END AS hit, cap FROM g, c),
q AS (SELECT i AS position, (0.5e0 + i) / 40e0 AS prob FROM (SELECT unnest(range(40)) AS i)),
a AS (SELECT count(*) AS n_values, CAST(sum(hit) AS BIGINT) AS n_capped, max(g) AS cap,
   quantile_cont(g, [%s]) AS qs FROM w)
SELECT CAST(position AS INTEGER) AS position, prob, qs[position + 1] AS quantile, n_values, n_capped, cap FROM q, a
""" % ", ".join(repr((0.5 + i) / 40) for i in range(40)), "prob quantile cap", 8)
def a14(v):
    return census.quantile_fit(v.record.select((F.col("price") / lit(1e3)).alias("g")), "g")


@query("a15_two_sample_shift", """
WITH m AS (SELECT depth AS x, count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 0) AS b FROM tce GROUP BY depth),
c AS (SELECT abs(sum(a) OVER (ORDER BY x) / (sum(a) OVER ())::DOUBLE - sum(b) OVER (ORDER BY x) / (sum(b) OVER ())::DOUBLE) AS d,
   sum(a) OVER () AS na, sum(b) OVER () AS nb FROM m),
s AS (SELECT max(d) AS ks, CAST(max(na) AS BIGINT) AS n_first, CAST(max(nb) AS BIGINT) AS n_second FROM c),
l AS (SELECT *, ks * sqrt(n_first::DOUBLE * n_second / (n_first + n_second)) AS lam FROM s),
p AS (SELECT *, CASE WHEN lam < 0.2e0 THEN 1e0 ELSE least(greatest(list_sum(list_transform(range(1, 31),
    lambda j: 2e0 * pow(-1e0, j - 1) * exp(-2e0 * j * j * lam * lam))), 0e0), 1e0) END AS p_value FROM l),
d AS (SELECT median(depth) FILTER (WHERE label = 1) AS a, median(depth) FILTER (WHERE label = 0) AS b FROM tce)
SELECT ks, n_first, n_second, p_value, a AS median_first, b AS median_second, abs(a - b) / greatest(b, 1e-9) AS median_offset,
  CASE WHEN p_value < 0.01e0 AND abs(a - b) / greatest(b, 1e-9) > 0.2e0 THEN 1 ELSE 0 END AS tripped FROM p, d""",
       "ks p_value median_first median_second median_offset")
def a15(v):
    return census.distribution_shift(v.tce.select("depth", "label"), "depth", F.col("label") == 1)


PROFILE_BINS = 400


@query("a16_folded_profile", f"""
WITH pb AS (SELECT tic, least(CAST(floor(phase * {PROFILE_BINS}e0) AS BIGINT), {PROFILE_BINS - 1}) AS b, median(flux) AS m, count(*) AS n FROM lc GROUP BY ALL),
ps AS (SELECT tic, median(m) AS base, CAST(sum(n) AS BIGINT) AS n_cadences FROM pb GROUP BY tic),
pd AS (SELECT ps.tic, g.i, ps.base - pb.m AS d, n_cadences FROM ps CROSS JOIN (SELECT unnest(range({PROFILE_BINS})) AS i) g
  LEFT JOIN pb ON pb.tic = ps.tic AND pb.b = g.i),
pl AS (SELECT tic, list(d ORDER BY i) AS dl, arg_min(i, (-d, i)) AS i1, max(d) AS d1, any_value(n_cadences) AS n_cadences FROM pd GROUP BY tic),
p2 AS (SELECT pd.tic, arg_min(pd.i, (-pd.d, pd.i)) AS i2, max(pd.d) AS d2 FROM pd JOIN pl ON pl.tic = pd.tic
  WHERE pd.d IS NOT NULL AND {CIRC.format(f'((pd.i + 0.5e0) / {PROFILE_BINS}e0)', f'((pl.i1 + 0.5e0) / {PROFILE_BINS}e0)')} > 0.15e0 GROUP BY pd.tic),
j AS (SELECT pl.*, i2, d2 FROM pl LEFT JOIN p2 ON p2.tic = pl.tic)
SELECT tic, n_cadences, (i1 + 0.5e0) / {PROFILE_BINS}e0 AS prim_pos, d1 AS prim_depth, (i2 + 0.5e0) / {PROFILE_BINS}e0 AS sec_pos, d2 AS sec_depth,
  (coalesce(list_min(list_filter(range(1, {PROFILE_BINS // 2 + 1}), lambda x: NOT coalesce(dl[(i1 - x + {PROFILE_BINS}) % {PROFILE_BINS} + 1] > 0.1e0 * d1, false))) - 1, {PROFILE_BINS // 2})
   + coalesce(list_min(list_filter(range(1, {PROFILE_BINS // 2 + 1}), lambda x: NOT coalesce(dl[(i1 + x) % {PROFILE_BINS} + 1] > 0.1e0 * d1, false))) - 1, {PROFILE_BINS // 2}) + 1) / {PROFILE_BINS}e0 AS prim_width,
  CASE WHEN i2 IS NOT NULL THEN
  (coalesce(list_min(list_filter(range(1, {PROFILE_BINS // 2 + 1}), lambda x: NOT coalesce(dl[(i2 - x + {PROFILE_BINS}) % {PROFILE_BINS} + 1] > 0.1e0 * d2, false))) - 1, {PROFILE_BINS // 2})
   + coalesce(list_min(list_filter(range(1, {PROFILE_BINS // 2 + 1}), lambda x: NOT coalesce(dl[(i2 + x) % {PROFILE_BINS} + 1] > 0.1e0 * d2, false))) - 1, {PROFILE_BINS // 2}) + 1) / {PROFILE_BINS}e0 END AS sec_width
FROM j""", "prim_pos prim_depth prim_width sec_pos sec_depth sec_width")
def a16(v):
    return evaluate.folded_profile(v.lc.select("tic", "phase", "flux"), PROFILE_BINS, 0.15)


VERDICT_SQL = f"""vd AS (SELECT model_idx, count(*) AS n_lead_events, max(score) AS max_lead_score,
   CASE WHEN max(score) >= {TAU}e0 THEN 1 ELSE 0 END AS vetter_pass FROM lab WHERE is_lead = 1 GROUP BY model_idx)"""


def verdicts(v):
    from dipsift.plans.q_views import labelled
    return evaluate.test_verdicts(labelled(v), TAU)


@query("a18_test_verdicts", f"WITH {RECOVERY_SQL}, {VERDICT_SQL} SELECT * FROM vd", "max_lead_score")
def a18(v):
    return verdicts(v)


WILSON = "(({p} + {z} * {z} / (2e0 * {n})) {s} {z} * sqrt({p} * (1e0 - {p}) / {n} + {z} * {z} / (4e0 * {n} * {n}))) / (1e0 + {z} * {z} / {n})"


def wilson_sql(a, n, z, sign):
    p = f"({a}::DOUBLE / nullif({n}, 0))"
    return WILSON.format(p=p, n=f"nullif({n}, 0)::DOUBLE", z=z, s=sign)


@query("a17_completeness", f"""WITH {RECOVERY_SQL}, {VERDICT_SQL},
bx AS (SELECT min(rp_over_rstar_model) AS lo, max(rp_over_rstar_model) AS hi FROM recov),
tt AS (SELECT r.*, coalesce(vd.vetter_pass, 0) AS vetter_pass FROM recov r LEFT JOIN vd ON vd.model_idx = r.model_idx),
se AS (SELECT *, CASE WHEN program = 'secondary_all63' THEN 'secondary' ELSE 'headline' END AS series, 9 AS nb FROM tt
  UNION ALL SELECT *, program, 6 FROM tt WHERE program LIKE 'per_system%'),
ce AS (SELECT series, nb, CAST(least(greatest(floor((rp_over_rstar_model - lo) / (hi - lo) * nb), 0), nb - 1) AS INTEGER) AS bin,
   count(*) AS n, CAST(sum(recovered) AS BIGINT) AS r, count(*) FILTER (WHERE recovered = 1 AND vetter_pass = 1) AS p FROM se, bx GROUP BY ALL),
gr AS (SELECT series, nb, unnest(range(nb)) AS bin FROM (SELECT DISTINCT series, nb FROM ce)),
o AS (SELECT gr.series, CAST(gr.bin AS INTEGER) AS bin, lo + (hi - lo) / gr.nb * gr.bin AS bin_lo, lo + (hi - lo) / gr.nb * (gr.bin + 1) AS bin_hi,
   coalesce(n, 0) AS n_tests, coalesce(r, 0) AS n_recovered, coalesce(p, 0) AS n_pass
  FROM bx CROSS JOIN gr LEFT JOIN ce ON ce.series = gr.series AND ce.nb = gr.nb AND ce.bin = gr.bin)
SELECT *, n_recovered::DOUBLE / nullif(n_tests, 0) AS recovered_frac, {wilson_sql('n_recovered', 'n_tests', '1e0', '-')} AS recovered_lo,
  {wilson_sql('n_recovered', 'n_tests', '1e0', '+')} AS recovered_hi, n_pass::DOUBLE / nullif(n_recovered, 0) AS pass_frac,
  {wilson_sql('n_pass', 'n_recovered', '1e0', '-')} AS pass_lo, {wilson_sql('n_pass', 'n_recovered', '1e0', '+')} AS pass_hi FROM o""",
       "bin_lo bin_hi recovered_frac recovered_lo recovered_hi pass_frac pass_lo pass_hi")
def a17(v):
    t = recovered_tests(v).join(verdicts(v).select("model_idx", "vetter_pass"), "model_idx", "left").fillna(0, ["vetter_pass"])
    per = F.when(F.col("program").startswith("per_system"), F.col("program"))
    main = F.when(F.col("program") == "secondary_all63", "secondary").otherwise("headline")
    series = F.filter(F.array(main, per), lambda s: s.isNotNull())
    n_bins = F.when(F.col("series").isin("headline", "secondary"), 9).otherwise(6)
    return evaluate.completeness(t, series, n_bins)


@query("a19_mission_rollup", f"""WITH {KNOWN_SQL},
pool AS (SELECT CASE tic % 3 WHEN 0 THEN 'TESS' ELSE 'Kepler' END AS mission, t.* FROM tce t WHERE tic % 3 < 2),
a AS (SELECT mission, count(*) FILTER (WHERE event_id IN (SELECT event_id FROM km)) AS d1,
  count(*) FILTER (WHERE event_id IN (SELECT event_id FROM km) AND snr >= 12e0) AS n_pass FROM pool GROUP BY mission),
b AS (SELECT ['TESS', 'Kepler', 'K2'][tic % 3 + 1] AS mission, count(*) AS d2 FROM kn GROUP BY 1),
f AS (SELECT mission, coalesce(d1, 0) AS d1, coalesce(n_pass, 0) AS n_pass, coalesce(d2, 0) AS d2 FROM a FULL JOIN b USING (mission))
SELECT *, CASE WHEN d1 > 0 THEN greatest(0e0, {wilson_sql('n_pass', 'd1', '1.96e0', '-')}) END AS wilson_lo,
  CASE WHEN d1 > 0 THEN least(1e0, {wilson_sql('n_pass', 'd1', '1.96e0', '+')}) END AS wilson_hi FROM f""", "wilson_lo wilson_hi")
def a19(v):
    ev, kn = matching.matched_to_known(v.tce.select("tic", "event_id", "event_time", "duration", "snr"),
                                       in_window(v).select("tic", "known_id", "t_known", "t_unc"))
    kind = F.when(F.col("tic") % 3 == 2, "secondary").otherwise("planet")
    mission = F.when(F.col("tic") % 3 == 0, "TESS").when(F.col("tic") % 3 == 1, "Kepler").otherwise("K2")
    # One mission has known times but no event of its kind.
    return matching.mission_rollup(ev.withColumns({"kind": kind, "mission": mission, "passed": F.col("snr") >= lit(12)}),
                                   kn.withColumns({"kind": F.lit("planet"), "mission": mission}))


OP_A = "(snr >= 5e0 AND t_dur <= 1e0 AND n_detrend_detections > 18 AND coalesce(skye_flag, 0) = 0)"
OP_B = f"({OP_A} AND best_fit IN ('T', 'AT'))"
TEST_SQL = f"""te AS (SELECT *, label = 1 AS pooled, label = 1 AND depth BETWEEN 0.0015e0 AND 0.003e0 AS stratum,
   label = 0 AND label_source = 0 AS real_neg, {OP_A} AS op_a, {OP_B} AS op_b FROM record WHERE rebalance_keep = 1 AND split = 'test'),
m0 AS (SELECT count(DISTINCT (tic, sector)) AS n_files, count(DISTINCT (tic, sector)) FILTER (WHERE real_neg) AS n_real_files,
  count(*) FILTER (WHERE pooled) AS n_pooled, count(*) FILTER (WHERE stratum) AS n_stratum,
  avg(op_a::INT) FILTER (WHERE pooled) AS ra_p, avg(op_b::INT) FILTER (WHERE pooled) AS rb_p,
  avg(op_a::INT) FILTER (WHERE stratum) AS ra_s, avg(op_b::INT) FILTER (WHERE stratum) AS rb_s,
  count(*) FILTER (WHERE real_neg AND op_a) AS fp_a, count(*) FILTER (WHERE real_neg AND op_b) AS fp_b FROM te),
m1 AS (SELECT 'A' AS point, 'pooled' AS scope, n_pooled AS n_positive, ra_p AS recall, fp_a AS real_fp, n_files, n_real_files FROM m0
  UNION ALL SELECT 'A', 'stratum', n_stratum, ra_s, fp_a, n_files, n_real_files FROM m0
  UNION ALL SELECT 'B', 'pooled', n_pooled, rb_p, fp_b, n_files, n_real_files FROM m0
  UNION ALL SELECT 'B', 'stratum', n_stratum, rb_s, fp_b, n_files, n_real_files FROM m0)"""


def arms_sql(arms):
    return " UNION ALL ".join(f"SELECT '{a}' AS arm, {c} AS sc, te.* FROM te" for a, c in arms.items())


def matched_sql(arms):
    return f"""{TEST_SQL}, ar AS ({arms_sql(arms)}),
ps AS (SELECT arm, 'pooled' AS scope, sc FROM ar WHERE pooled UNION ALL SELECT arm, 'stratum', sc FROM ar WHERE stratum),
od AS (SELECT *, row_number() OVER (PARTITION BY arm, scope ORDER BY sc) - 1 AS i, count(*) OVER (PARTITION BY arm, scope) AS n FROM ps),
ta AS (SELECT od.arm, m1.point, od.scope, max(sc) FILTER (WHERE i = floor((n - 1) * (1e0 - recall))) AS a,
   max(sc) FILTER (WHERE i = ceil((n - 1) * (1e0 - recall))) AS b, any_value((n - 1) * (1e0 - recall) - floor((n - 1) * (1e0 - recall))) AS w
  FROM od JOIN m1 ON m1.scope = od.scope GROUP BY od.arm, m1.point, od.scope),
tau AS (SELECT arm, point, scope, a + (b - a) * w AS tau FROM ta),
mr AS (SELECT tau.arm, tau.point, tau.scope, m1.recall AS base_recall, tau.tau, count(*) FILTER (WHERE real_neg AND sc >= tau.tau) AS fp,
   1e3 * count(*) FILTER (WHERE real_neg AND sc >= tau.tau) / greatest(any_value(n_real_files), 1) AS fp_per_1000,
   1e3 * any_value(real_fp) / greatest(any_value(n_real_files), 1) AS base_fp_per_1000,
   count(*) FILTER (WHERE sc >= tau.tau AND (real_neg OR (tau.scope = 'pooled' AND pooled) OR (tau.scope = 'stratum' AND stratum))) AS queue
  FROM tau JOIN m1 ON m1.point = tau.point AND m1.scope = tau.scope JOIN ar ON ar.arm = tau.arm GROUP BY ALL)"""


@query("a20_operating_point_recall", f"""WITH {TEST_SQL}
SELECT point, scope, n_positive, recall, real_fp, 1e3 * real_fp / greatest(n_files, 1) AS fp_per_1000, n_files FROM m1""", "recall fp_per_1000")
def a20(v):
    return evaluate.operating_point_table(v.record)


@query("a21_matched_recall", f"WITH {matched_sql(ARMS)} SELECT * FROM mr", "base_recall tau fp_per_1000 base_fp_per_1000")
def a21(v):
    return evaluate.matched_recall(v.record, ARMS)


@query("a22_cluster_bootstrap", f"""WITH {matched_sql(ARMS)},
pt AS (SELECT ar.tic, tau.arm, tau.point, tau.scope, count(*) FILTER (WHERE sc >= tau.tau) AS c FROM ar JOIN tau ON tau.arm = ar.arm
   WHERE real_neg GROUP BY ALL),
ix AS (SELECT tic, row_number() OVER (ORDER BY tic) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT tic FROM pt)),
bl AS (SELECT b, CAST(floor(floor({u_sql('boot', 'b', 'idx')} * n) / 256e0) AS BIGINT) AS block, any_value(n) AS n, count(*) AS c
   FROM ix CROSS JOIN (SELECT unnest(range(2000)) AS b) GROUP BY 1, 2),
sl AS (SELECT b, block, n, unnest(range(c)) AS j FROM bl),
dr AS (SELECT b, block * 256 + CAST(floor({u_sql('boot.in', 'b', 'block', 'j')} * least(256, n - block * 256)) AS BIGINT) AS pick FROM sl),
sm AS (SELECT arm, scope, point, b, 1e3 * sum(c) / greatest((SELECT n_real_files FROM m0), 1) AS rate
  FROM dr JOIN ix ON ix.idx = dr.pick JOIN pt ON pt.tic = ix.tic GROUP BY arm, scope, point, b)
SELECT arm, scope, point, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi, avg(rate) AS mean_rate FROM sm GROUP BY ALL""",
       "lo hi mean_rate", 6)
def a22(v):
    return evaluate.cluster_bootstrap(v.record, ARMS)


@query("a23_recall_at_budget", f"""WITH {TEST_SQL}, ar AS ({arms_sql(ARMS)}),
ng AS (SELECT arm, sc, row_number() OVER (PARTITION BY arm ORDER BY sc DESC) AS i FROM ar WHERE real_neg),
tb AS (SELECT ng.arm, m1.point, m1.scope, any_value(m1.real_fp) AS fp_budget, max(sc) FILTER (WHERE i = real_fp) AS tau, any_value(n_files) AS nf
  FROM ng, m1 GROUP BY ng.arm, m1.point, m1.scope)
SELECT tb.arm, tb.point, tb.scope, fp_budget, tau, count(*) FILTER (WHERE real_neg AND sc >= tau) AS fp,
  avg((sc >= tau)::INT) FILTER (WHERE (scope = 'pooled' AND pooled) OR (scope = 'stratum' AND stratum)) AS recall,
  1e3 * fp_budget / nf AS budget_per_1000_files FROM tb JOIN ar ON ar.arm = tb.arm GROUP BY tb.arm, tb.point, tb.scope, fp_budget, tau, nf""",
       "tau recall budget_per_1000_files")
def a23(v):
    return evaluate.recall_at_budget(v.record, ARMS)


LADDER = {"b_nopair": "score_base", "b": "score"}


@query("a24_ablation_contrast", f"""WITH {matched_sql(LADDER)}
SELECT point, scope, max(fp) FILTER (WHERE arm = 'b') AS b, max(fp) FILTER (WHERE arm = 'b_nopair') AS b_nopair,
  max(fp) FILTER (WHERE arm = 'b_nopair') - max(fp) FILTER (WHERE arm = 'b') AS contrast FROM mr GROUP BY point, scope""")
def a24(v):
    return evaluate.ablation_contrast(evaluate.matched_recall(v.record, LADDER), "b", "b_nopair")


@query("a25_detectable_effect", """
SELECT count(DISTINCT tic) AS n_systems, 2.8e0 * sqrt(2e0 * 0.5e0 * 0.5e0 / count(DISTINCT tic)) AS mde_half,
  2.8e0 * sqrt(2e0 * avg(label) * (1e0 - avg(label)) / count(DISTINCT tic)) AS mde_observed
FROM record WHERE split = 'test'""", "mde_half mde_observed")
def a25(v):
    t = v.record.where("split = 'test'").agg(F.countDistinct("tic").alias("n_systems"), F.avg("label").alias("_p"))
    return t.select("n_systems", rank.mde(0.5, F.col("n_systems")).alias("mde_half"),
                    rank.mde(F.col("_p"), F.col("n_systems")).alias("mde_observed"))


@query("a26_ranking_quality", """
WITH ar AS (SELECT 'b' AS arm, score AS s, label FROM record WHERE split = 'val' UNION ALL SELECT 'b0', score_base, label FROM record WHERE split = 'val'),
g AS (SELECT arm, s, sum(label) AS p, count(*) AS c FROM ar GROUP BY arm, s),
w AS (SELECT *, sum(p) OVER lo AS p_le, sum(c) OVER lo AS c_le, sum(p) OVER hi AS p_ge, sum(c) OVER hi AS c_ge,
   sum(p) OVER (PARTITION BY arm) AS np, sum(c) OVER (PARTITION BY arm) AS n FROM g
  WINDOW lo AS (PARTITION BY arm ORDER BY s), hi AS (PARTITION BY arm ORDER BY s DESC)),
a AS (SELECT arm, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n,
   sum(p * ((c_le - p_le) - (c - p) / 2e0)) / (max(np) * (max(n) - max(np)))::DOUBLE AS roc_auc,
   sum(p * (p_ge / c_ge::DOUBLE)) / max(np) AS average_precision FROM w GROUP BY arm)
SELECT *, greatest(roc_auc, 1e0 - roc_auc) AS auc_folded, n_pos / n::DOUBLE AS prior, average_precision - n_pos / n::DOUBLE AS lift FROM a""",
       "roc_auc average_precision auc_folded prior lift")
def a26(v):
    val = v.record.where("split = 'val'").select("label", F.explode(F.array(*[
        F.struct(F.lit(a).alias("arm"), F.col(c).alias("s")) for a, c in ARMS.items()])).alias("_a"))
    return rank.ranking_quality(val.select("_a.*", "label"), ["arm"], "s", "label")


N_SQL = "(sqrt(-2e0 * ln(1e0 - {r})) * cos(6.283185307179586e0 * {a}))"


def normal_sql(seed, *key):
    return N_SQL.format(r=u_sql(seed + ".r", *key), a=u_sql(seed + ".a", *key))


def f2_sql(x):
    xs, ys = [math.log10(s) for s in k.YIELD_SIGMA], k.YIELD_FRACTION
    out = f"CASE WHEN {x} <= {xs[0]!r} THEN {ys[0]}e0"
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out += f" WHEN {x} <= {x1!r} THEN {y0}e0 + ({x} - ({x0!r})) * ({(y1 - y0) / (x1 - x0)!r}::DOUBLE)"
    return out + f" ELSE {ys[-1]}e0 END"


YIELD_SQL = ORBIT_SQL.rstrip() + f""", ob AS (SELECT tic, sum(s) AS t_obs FROM (SELECT tic, sector, max(time) - min(time) AS s FROM lc GROUP BY tic, sector) GROUP BY tic),
dw AS (SELECT o.tic, t_obs, m, p_crit, CASE WHEN {u_sql('yield.tight', 'o.tic', 'm')} < 0.6e0 THEN -4e0 ELSE -3e0 END + {u_sql('yield.s', 'o.tic', 'm')} AS ls,
   p_crit * pow(10e0, {u_sql('yield.pp', 'o.tic', 'm')} * CASE WHEN {u_sql('yield.tail', 'o.tic', 'm')} < 0.2e0 THEN 1e0 ELSE {math.log10(3.0)!r} END) AS pp,
   least(greatest(0.41e0 + 0.12e0 * {normal_sql('yield.lead', 'o.tic', 'm')}, 0.05e0), 0.95e0) AS r1,
   least(greatest(0.41e0 + 0.12e0 * {normal_sql('yield.partner', 'o.tic', 'm')}, 0.05e0), 0.95e0) AS r2
  FROM o JOIN ob ON ob.tic = o.tic CROSS JOIN (SELECT unnest(range(24)) AS m) WHERE t_obs > 0),
lm AS (SELECT *, t_obs / pp * ({f2_sql('ls')}) * 0.8e0 * r1 * r2 AS lam FROM dw),
ph AS (SELECT tic, max(t_obs) AS t_obs, median(lam) AS median_lambda, 1e0 - exp(sum(ln(1e0 - (1e0 - exp(-lam)) * 0.85e0))) AS p_host FROM lm GROUP BY tic)"""


def yield_hosts(v):
    obs = gaps_baseline(v)
    return evaluate.expected_yield(hosts.orbit_columns(v.host).select("tic", "period", "p_crit").join(obs, "tic"))


@query("a27_expected_yield", YIELD_SQL + " SELECT * FROM ph", "t_obs median_lambda p_host")
def a27(v):
    return yield_hosts(v)


@query("a27_expected_yield_total", YIELD_SQL + """ SELECT count(*) AS n_hosts, sum(p_host) AS expected, count(*) FILTER (WHERE p_host > 0.5e0) AS n_above_half,
  CASE WHEN sum(p_host) >= 30 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS verdict FROM ph""", "expected", 6)
def a27_total(v):
    return evaluate.expected_yield_total(yield_hosts(v))


@query("a28_sector_bounds", """
WITH shipped AS (SELECT sector, (sector - 1) * 7e0 AS start_time, sector * 7e0 AS end_time FROM lc WHERE sector <= 3 GROUP BY sector),
new AS (SELECT sector, min(time) AS start_time, max(time) AS end_time FROM lc WHERE sector NOT IN (SELECT sector FROM shipped) GROUP BY sector),
ext AS (SELECT * FROM shipped UNION ALL SELECT * FROM new)
SELECT *, CASE WHEN (SELECT min(sector) = 1 AND max(sector) = count(*) FROM ext) THEN 1 ELSE 0 END AS contiguous FROM ext""", "start_time end_time")
def a28(v):
    shipped = v.lc.where("sector <= 3").select("sector").distinct().select(
        "sector", ((F.col("sector") - 1) * lit(7)).alias("start_time"), (F.col("sector") * lit(7)).alias("end_time"))
    return queue.extended_sector_bounds(shipped, v.lc)


def gaps_baseline(v):
    return queue.observed_baseline(v.lc)


@query("a29_observed_baseline", """SELECT tic, sum(s) AS t_obs FROM (SELECT tic, sector, max(time) - min(time) AS s FROM lc GROUP BY tic, sector) GROUP BY tic""", "t_obs")
def a29(v):
    return gaps_baseline(v)


@query("a30_queue_summary", f"""
SELECT count(*) AS n_events, count(DISTINCT tic) AS n_systems, count(*) FILTER (WHERE score >= {TAU}e0) AS n_above_tau,
  count(DISTINCT (tic, sector)) FILTER (WHERE sector <= 3) AS overlap_files, count(*) FILTER (WHERE sector <= 3) AS overlap_events,
  quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.9) AS q90, quantile_cont(score, 0.99) AS q99 FROM record""", "q50 q90 q99")
def a30(v):
    return evaluate.queue_summary(v.record.withColumn("overlap", (F.col("sector") <= 3).cast("int")), TAU)


@query("a31_events_per_host_sector", f"""
SELECT t.tic, t.sector, count(*) AS n_events, count(*) FILTER (WHERE coalesce({CIRC.format('t.phase', 'h.prim_pos')} <= h.prim_width / 2e0, false)
    OR coalesce({CIRC.format('t.phase', 'h.sec_pos')} <= h.sec_width / 2e0, false)) AS n_inside_mask
FROM tce t JOIN host h ON h.tic = t.tic GROUP BY t.tic, t.sector""")
def a31(v):
    df = hosts.lookup(v.tce, v.host.select("tic", "prim_pos", "prim_width", "sec_pos", "sec_width"), ["event_id"])
    return df.groupBy("tic", "sector").agg(F.count(lit(1)).alias("n_events"), F.count_if(
        expr.in_eclipse(F.col("phase"), *eclipses())).alias("n_inside_mask"))


@query("a32_split_report", """
SELECT split, count(DISTINCT tic) AS n_systems, count(*) AS n_events, CAST(sum(label) AS BIGINT) AS n_positive,
  count(*) / (SELECT count(*) FROM record)::DOUBLE AS event_fraction FROM record GROUP BY split""", "event_fraction")
def a32(v):
    return split.split_report(v.record.drop("split"), v.record.select("tic", "split").distinct())


@query("a32_split_map_digest", """
WITH a AS (SELECT DISTINCT tic, split FROM record), h AS (SELECT md5(tic::VARCHAR || ':' || split) AS m FROM a)
SELECT sha256(count(*)::VARCHAR || ':' || sum(('0x' || substr(m, 1, 13))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(m, 14, 13))::BIGINT)::VARCHAR) AS digest FROM h""")
def a32_digest(v):
    return split.map_digest(v.record.select("tic", "split").distinct())


@query("a33_queue_profile", f"""
SELECT inverted_lc, count(*) AS n_events, count(DISTINCT (tic, sector)) AS n_files, median(n_detrend_detections) AS median_n,
  quantile_cont(n_detrend_detections, 0.25) AS p25_n, count(*) FILTER (WHERE n_detrend_detections = 21) / count(*)::DOUBLE AS share_ceiling,
  count(*) FILTER (WHERE n_detrend_detections <= 5) / count(*)::DOUBLE AS share_few,
  count(*) FILTER (WHERE (det_dependence = 1) <> (n_detrend_detections <= 18)) AS n_inconsistent,
  count(*) / count(DISTINCT (tic, sector))::DOUBLE AS events_per_file,
  abs(count(*) / count(DISTINCT (tic, sector))::DOUBLE - {k.QUEUE_EVENTS}e0 / {k.QUEUE_FILES}e0) / ({k.QUEUE_EVENTS}e0 / {k.QUEUE_FILES}e0) AS rate_offset
FROM tce GROUP BY inverted_lc""", "median_n p25_n share_ceiling share_few events_per_file rate_offset")
def a33(v):
    return queue.queue_profile(v.tce, ["inverted_lc"], k.QUEUE_EVENTS / k.QUEUE_FILES)


@query("a33_recovery_by_arm", f"""WITH {RECOVERY_SQL}
SELECT avg(recovered) FILTER (WHERE inverted_lc = 1) AS inverted_recovery, avg(recovered) FILTER (WHERE inverted_lc = 0) AS native_recovery,
 abs(avg(recovered) FILTER (WHERE inverted_lc = 1) - avg(recovered) FILTER (WHERE inverted_lc = 0)) / avg(recovered) AS relative_difference FROM recov""",
       "inverted_recovery native_recovery relative_difference")
def a33_recovery(v):
    return queue.recovery_by_arm(recovered_tests(v))


RANKED_SQL = """rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM (
  SELECT t.*, floor(%s * 1e3) / 1e3 AS score FROM tce t))""" % u_sql("queue", "event_id")


def scored_queue(v):
    scored = v.tce.withColumn("arm_b_score", F.floor(uniform("queue", F.col("event_id")) * lit(1e3)) / lit(1e3))
    return scored.withColumns({"best_fit_label": F.col("best_fit"), "coverage_tier": F.col("event_id") % 12,
                               "sector_overlap_frozen": (F.col("sector") <= 3).cast("int"), "disposition": F.lit("")})


PINNED_SQL = """tic, sector, event_time, phase, depth, duration, snr, n_detrend_detections, skye_flag, best_fit AS best_fit_label,
  score AS arm_b_score, rank, event_id % 12 AS coverage_tier, CASE WHEN sector <= 3 THEN 1 ELSE 0 END AS sector_overlap_frozen, '' AS disposition"""


@query("k1_ranked_queue", f"WITH {RANKED_SQL} SELECT {PINNED_SQL} FROM rk", "event_time phase depth duration snr arm_b_score")
def k1(v):
    return queue.ranked_queue(scored_queue(v), ["event_id"])


@query("k1_shortlist", f"WITH {RANKED_SQL} SELECT {PINNED_SQL} FROM rk WHERE rank <= 50", "event_time phase depth duration snr arm_b_score")
def k1_top(v):
    return queue.shortlist(scored_queue(v), ["event_id"], 50)


@query("k2_output_order", "SELECT CAST(tic AS VARCHAR) AS tic_text, event_time, snr FROM tce ORDER BY tic_text, event_time", "event_time snr")
def k2(v):
    return queue.output_order(v.tce).select(F.col("tic").cast("string").alias("tic_text"), "event_time", "snr")


@query("k3_top_systems", "SELECT tic, count(*) AS n_rows FROM record GROUP BY tic ORDER BY n_rows DESC, tic LIMIT 20")
def k3(v):
    return rank.top_by_count(v.record, "tic", 20)


@query("k4_ranked_pair_hosts", f"""WITH {NOISE_SQL}
SELECT tic, depth_ratio, 0.005e0 * depth_ratio / (rms_cadence / sqrt(12e0)) AS partner_snr, n_files FROM noise
WHERE depth_ratio >= 0.33e0 AND n_files >= 2 AND 0.005e0 * depth_ratio / (rms_cadence / sqrt(12e0)) >= 1e0
ORDER BY partner_snr DESC, tic LIMIT 25""", "depth_ratio partner_snr", 7)
def k4(v):
    n = noise_view(v)
    return hosts.ranked_pair_hosts(n.drop("n_files"), n.select("tic", "n_files"), 25, snr_min=1.0) \
        .select("tic", "depth_ratio", "partner_snr", "n_files")


@query("w8_rank_in_stratum", f"""WITH {SYSTEM_SQL}
SELECT tic, stratum, row_number() OVER (PARTITION BY stratum ORDER BY n_events DESC, tic) AS position FROM sysx""")
def w8(v):
    return queue.rank_in_group(split.system_table(v.record, v.host), "stratum", "n_events", "tic")
