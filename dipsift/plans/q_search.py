"""Queries: dip search, epoch placement, injection campaign (W7, R4, R5, R11, R13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipsift.functions import expr
from dipsift.functions.expr import lit
from dipsift.operators import chain, evaluate, gaps, hosts, injection, matching, search
from dipsift.plans.fixtures import u_sql
from dipsift.plans.q_clean import CIRC, EDGE_DISTANCE, EDGES_SQL, eclipses
from dipsift.plans.q_eval import histogram_rows
from dipsift.plans.registry import query

STEP, CADENCE, TOLERANCE = 1.0, 0.1, 0.5


def search_sql(source, keys, lengths):
    by = ", ".join(keys)
    win = ", ".join(f"({i}, {w!r}::DOUBLE, {round(w / 2 * 1_000_000)})" for i, w in enumerate(lengths))
    frame = f"PARTITION BY {by}, window_no ORDER BY t RANGE BETWEEN half PRECEDING AND half FOLLOWING"
    return f"""wl AS (SELECT * FROM (VALUES {win}) x(window_no, win_len, half)),
s0 AS (SELECT {by}, time, flux, CAST(round(time * 1e6) AS BIGINT) AS t, window_no, win_len, half FROM {source} CROSS JOIN wl),
s1 AS (SELECT *, flux / median(flux) OVER ({frame}) AS flat FROM s0),
s2 AS (SELECT *, 1.4826e0 * median(abs(flat - 1e0)) OVER ({frame}) AS sigma FROM s1),
s3 AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY {by}, window_no ORDER BY time) > {STEP}e0 THEN 1 ELSE 0 END AS br FROM s2
  WHERE sigma > 0 AND flat < 1e0 - 3e0 * sigma),
s4 AS (SELECT *, sum(br) OVER (PARTITION BY {by}, window_no ORDER BY time) AS run FROM s3),
pk AS (SELECT {by}, window_no, any_value(win_len) AS win_len, arg_min(time, (flat, time)) AS event_time, 1e0 - min(flat) AS depth,
   max(time) - min(time) + {CADENCE}e0 AS duration, (1e0 - min(flat)) / arg_min(sigma, (flat, time)) * sqrt(count(*)) AS snr
  FROM s4 GROUP BY {by}, window_no, run),
g1 AS (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY {by} ORDER BY event_time) > {TOLERANCE}e0 THEN 1 ELSE 0 END AS br FROM pk),
g2 AS (SELECT *, CAST(sum(br) OVER (PARTITION BY {by} ORDER BY event_time) AS BIGINT) AS group_id FROM g1),
found AS (SELECT {by}, group_id, {", ".join(f"arg_max({c}, (round(snr, 9), -event_time, -win_len)) AS {c}" for c in ("event_time", "depth", "duration", "win_len", "snr"))}, count(*) AS n_detrend_detections FROM g2 GROUP BY {by}, group_id)"""


def in_view(v):
    return v.lc.select("tic", "sector", "time", "flux")


@query("w7_flatten_and_flag", f"""WITH {search_sql('lc', ['tic', 'sector'], search.window_lengths())}
SELECT tic, sector, window_no AS "window", event_time, depth, duration, snr FROM pk""", "event_time depth duration snr", 7)
def w7(v):
    flat = search.flattened(in_view(v), ["tic", "sector"], search.window_lengths(), below=search.MAD_THRESHOLD)
    return search.peaks(flat, ["tic", "sector"], STEP, CADENCE).select(
        "tic", "sector", "window", "event_time", "depth", "duration", "snr")


@query("w7_search_events", f"""WITH {search_sql('lc', ['tic', 'sector'], search.window_lengths())}
SELECT tic, sector, group_id, event_time, depth, duration, win_len, snr, n_detrend_detections,
  CASE WHEN n_detrend_detections <= 18 THEN 1 ELSE 0 END AS det_dependence FROM found""", "event_time depth duration win_len snr", 7)
def w7_events(v):
    return search.search(in_view(v), ["tic", "sector"], search.window_lengths(), STEP, CADENCE, TOLERANCE).select(
        "tic", "sector", "group_id", "event_time", "depth", "duration", "win_len", "snr", "n_detrend_detections", "det_dependence")


ELIGIBLE_SQL = f"""el AS (SELECT l.* FROM lc l JOIN host h ON h.tic = l.tic WHERE NOT (
    coalesce({CIRC.format('l.phase', 'h.prim_pos')} <= h.prim_width / 2e0, false) OR coalesce({CIRC.format('l.phase', 'h.sec_pos')} <= h.sec_width / 2e0, false)))"""


def eligible(v):
    df = hosts.lookup(v.lc, v.host.select("tic", "prim_pos", "prim_width", "sec_pos", "sec_width"), ["event_id"])
    return df.where(~expr.in_eclipse(F.col("phase"), *eclipses()))


@query("r5_uniform_epochs", f"""WITH {ELIGIBLE_SQL},
n AS (SELECT tic, sector, time, row_number() OVER (PARTITION BY tic, sector ORDER BY time) AS i, count(*) OVER (PARTITION BY tic, sector) AS n FROM el)
SELECT t.model_idx, n.time AS inj_time FROM tests t JOIN n ON n.tic = t.tic AND n.sector = t.sector
 AND n.i = floor({u_sql('epoch5', 't.model_idx')} * n.n) + 1""", "inj_time")
def r5(v):
    return injection.uniform_epochs(eligible(v), v.tests, "epoch5").select("model_idx", "inj_time")


TRIES = 20
GAP_BIN = "CASE WHEN d_gap < 0.1 THEN 0 WHEN d_gap < 0.25 THEN 1 WHEN d_gap < 0.5 THEN 2 WHEN d_gap < 1 THEN 3 WHEN d_gap < 2 THEN 4 WHEN d_gap < 4 THEN 5 WHEN d_gap < 8 THEN 6 ELSE 7 END"
EPOCH_SQL = f"""{EDGES_SQL}, {ELIGIBLE_SQL},
f AS (SELECT t.* FROM tce t WHERE snr >= 5e0 AND duration <= 1e0 AND det_dependence = 0 AND coalesce(skye_flag, 0) = 0),
hg AS (SELECT {EDGE_DISTANCE} AS d_phi, (SELECT min(abs(e.time - t.event_time)) FROM edges e SEMI JOIN sized USING (tic, sector)
    WHERE e.tic = t.tic AND e.sector = t.sector) AS d_gap FROM f t JOIN host h ON h.tic = t.tic),
hb AS (SELECT CAST(least(floor(d_phi / 0.5e0 * 10e0), 9) * 8 + {GAP_BIN} AS BIGINT) AS bin FROM hg WHERE d_phi BETWEEN 0e0 AND 0.5e0 AND d_gap BETWEEN 0e0 AND 30e0),
hm AS (SELECT g.bin, count(hb.bin) AS n FROM (SELECT unnest(range(80)) AS bin) g LEFT JOIN hb ON hb.bin = g.bin GROUP BY g.bin),
hc AS (SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total FROM hm),
cg AS (SELECT t.tic, t.sector, t.time, coalesce({EDGE_DISTANCE}, 0e0) AS d_phi, (SELECT min(abs(e.time - t.time)) FROM edges e
    WHERE e.tic = t.tic AND e.sector = t.sector) AS d_gap FROM el t JOIN host h ON h.tic = t.tic),
cb AS (SELECT tic, sector, time, CAST(least(greatest(floor(d_phi / 0.5e0 * 10e0), 0), 9) * 8 + {GAP_BIN} AS BIGINT) AS bin FROM cg),
cn AS (SELECT *, row_number() OVER (PARTITION BY tic, sector, bin ORDER BY time) AS i FROM cb),
cc AS (SELECT tic, sector, bin, count(*) AS n FROM cb GROUP BY ALL),
av AS (SELECT cc.*, hc.n AS mass, CAST(sum(hc.n) OVER (PARTITION BY tic, sector ORDER BY cc.bin) AS BIGINT) AS mcum, CAST(sum(hc.n) OVER (PARTITION BY tic, sector) AS BIGINT) AS mtot,
   CAST(sum(cc.n) OVER (PARTITION BY tic, sector ORDER BY cc.bin) AS BIGINT) AS ncum, CAST(sum(cc.n) OVER (PARTITION BY tic, sector) AS BIGINT) AS ntot FROM cc JOIN hc ON hc.bin = cc.bin),
att AS (SELECT t.model_idx, t.tic, t.sector, a, CASE a {' '.join(f"WHEN {a} THEN {u_sql(f'r4.try{a}', 't.model_idx')}" for a in range(TRIES))} END AS u
  FROM tests t CROSS JOIN (SELECT unnest(range({TRIES})) AS a)),
ab AS (SELECT att.*, (SELECT min(bin) FROM hc WHERE cum > floor(att.u * hc.total)) AS bin FROM att),
ok AS (SELECT ab.model_idx, min(a) AS a, arg_min(ab.bin, a) AS bin FROM ab JOIN cc ON cc.tic = ab.tic AND cc.sector = ab.sector AND cc.bin = ab.bin GROUP BY ab.model_idx),
fb AS (SELECT t.model_idx, min(av.bin) FILTER (WHERE mtot > 0 AND mcum > floor({u_sql('r4.fall', 't.model_idx')} * mtot)) AS nb,
   min(av.bin) FILTER (WHERE ncum > floor({u_sql('r4.fall', 't.model_idx')} * ntot)) AS ub FROM tests t JOIN av ON av.tic = t.tic AND av.sector = t.sector GROUP BY t.model_idx),
ch AS (SELECT t.model_idx, t.tic, t.sector, coalesce(ok.bin, fb.nb, fb.ub) AS bin,
   CASE WHEN ok.a = 0 THEN 'bin_hit' WHEN ok.a IS NOT NULL THEN 'redraw' WHEN fb.nb IS NOT NULL THEN 'nearest' ELSE 'uniform' END AS outcome
  FROM tests t JOIN fb ON fb.model_idx = t.model_idx LEFT JOIN ok ON ok.model_idx = t.model_idx),
r4 AS (SELECT ch.model_idx, ch.outcome, CAST(ch.bin AS BIGINT) AS bin, cn.time AS inj_time FROM ch JOIN cc ON cc.tic = ch.tic AND cc.sector = ch.sector AND cc.bin = ch.bin
  JOIN cn ON cn.tic = ch.tic AND cn.sector = ch.sector AND cn.bin = ch.bin AND cn.i = floor({u_sql('r4.pick', 'ch.model_idx')} * cc.n) + 1)"""


def matched(v):
    flat_bin = (F.col("phase_bin") * 8 + F.col("gap_bin")).cast("bigint")
    hist = evaluate.joint_histogram(histogram_rows(v), "d_phi", "d_gap").select(flat_bin.alias("bin"), "n")
    d_phi = F.coalesce(expr.eclipse_edge_distance(F.col("phase"), *eclipses()), lit(0))
    # The host's columns end here, so that only the phase bin goes through the lookup of the gaps.
    pts = gaps.gap_distance(v.lc, eligible(v).select("tic", "sector", "time", expr.bin_of(d_phi, 0.0, 0.5, 10).alias("phase_bin")), "time", name="d_gap")
    cad = pts.select("tic", "sector", "time", (F.col("phase_bin") * 8 + expr.bin_of_edges(
        F.coalesce("d_gap", lit(0)), [0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 30.0])).cast("bigint").alias("bin"))
    from dipsift.operators.lineage import materialise
    return injection.matched_epochs(materialise(cad, "binned-cadences"), materialise(hist, "histogram"), v.tests, "r4", TRIES)


@query("r4_matched_epochs", f"WITH {EPOCH_SQL} SELECT * FROM r4", "inj_time")
def r4(v):
    return matched(v).select("model_idx", "outcome", "bin", "inj_time")


@query("r4_placement_report", f"WITH {EPOCH_SQL} SELECT outcome, count(*) AS n, count(*) / (SELECT count(*) FROM r4)::DOUBLE AS share FROM r4 GROUP BY outcome", "share")
def r4_report(v):
    from dipsift.operators.lineage import materialise
    total = materialise(matched(v).groupBy("outcome").agg(F.count(lit(1)).alias("n")), "outcomes")  # read twice
    return total.withColumn("share", F.col("n") / total.select(F.sum("n")).scalar())


def campaign_tests(v):
    return v.tests.withColumns({"partner_duration_ratio": lit(0.5), "partner_ratio": lit(0.6)})


INJECT_SQL = """tr AS (SELECT model_idx, tic, sector, inj_time AS centre, inj_duration AS d, inj_depth AS dep FROM tests
  UNION ALL SELECT model_idx, tic, sector, partner_time, inj_duration * 0.5e0, inj_depth * 0.6e0 FROM tests WHERE partner_time IS NOT NULL),
dl AS (SELECT tr.model_idx, l.event_id AS cadence_id, sum(-dep * (1e0 - 0.35e0 * ((l.time - centre) / (d / 2e0)) * ((l.time - centre) / (d / 2e0)))) AS delta
  FROM tr JOIN lc l ON l.tic = tr.tic AND l.sector = tr.sector AND abs((l.time - centre) / (d / 2e0)) <= 1e0 GROUP BY ALL),
ij AS (SELECT t.model_idx, t.tic, t.sector, l.event_id AS cadence_id, l.time,
   CASE WHEN t.inverted_lc = 1 THEN ((l.flux - 1e0) * -1e0) + 1e0 ELSE l.flux END + coalesce(dl.delta, 0e0) AS flux
  FROM tests t JOIN lc l ON l.tic = t.tic AND l.sector = t.sector LEFT JOIN dl ON dl.model_idx = t.model_idx AND dl.cadence_id = l.event_id)"""


def cadences(v):
    return v.lc.select("tic", "sector", "time", "flux", "phase", F.col("event_id").alias("cadence_id"))


def injected(v):
    t = campaign_tests(v)
    return injection.injected_curves(cadences(v), t, injection.partner_transits(t), "cadence_id")


@query("r11_injected_flux", f"""WITH {INJECT_SQL}
SELECT model_idx, count(*) AS n_cadences, sum(flux) AS flux_sum, min(flux) AS flux_min, max(flux) AS flux_max FROM ij GROUP BY model_idx""",
       "flux_sum flux_min flux_max", 7)
def r11(v):
    return injected(v).groupBy("model_idx").agg(F.count(lit(1)).alias("n_cadences"), F.sum("flux").alias("flux_sum"),
                                                F.min("flux").alias("flux_min"), F.max("flux").alias("flux_max"))


LENGTHS = search.window_lengths()


@query("r13_campaign", f"""WITH {INJECT_SQL}, {search_sql('ij', ['model_idx'], LENGTHS)},
lb AS (SELECT f.*, CASE WHEN abs(f.event_time - t.inj_time) < t.inj_duration / 2e0 THEN 1 ELSE 0 END AS is_lead,
   CASE WHEN abs(f.event_time - t.partner_time) < t.inj_duration / 2e0 THEN 1 ELSE 0 END AS is_partner FROM found f JOIN tests t ON t.model_idx = f.model_idx)
SELECT t.model_idx, coalesce(max(is_lead), 0) AS recovered, coalesce(max(is_partner), 0) AS recovered_partner,
  coalesce(max(is_lead), 0) * coalesce(max(is_partner), 0) AS recovered_pair, count(lb.model_idx) AS n_events_flagged
FROM tests t LEFT JOIN lb ON lb.model_idx = t.model_idx GROUP BY t.model_idx""")
def r13(v):
    """Inject, search and label every test; a test whose curve holds no data keeps
    its row with nothing flagged."""
    t = campaign_tests(v)
    events = chain.searched_copies(cadences(v), t, injection.partner_transits(t), lengths=LENGTHS, max_step=STEP, cadence=CADENCE, tolerance=TOLERANCE)
    labelled = matching.recovery_labels(events, v.tests, ["model_idx"], ["group_id"])
    return matching.recovery_by_test(v.tests, labelled, ["model_idx"]).select(
        "model_idx", "recovered", "recovered_partner", "recovered_pair", "n_events_flagged")


def campaign_source(v):
    """Curves, eligible cadences, searched events and hosts of the campaign chain."""
    ratio = F.coalesce(F.col("sec_depth") / F.col("prim_depth"), lit(1)).alias("depth_ratio")
    return chain.Source(cadences(v),
                        eligible(v).select("tic", "sector", "time"), v.tce, hosts.orbit_columns(v.host).select("tic", "period", "p_crit", ratio),
                        searched={"lengths": LENGTHS, "max_step": STEP, "cadence": CADENCE, "tolerance": TOLERANCE})


@query("r13_campaign_chain")
def r13_chain(v):
    """The whole campaign in two ranges: plan, draws, blocked cadences, placement, injection, search, recovery."""
    from dipsift.plans.q_sources import folder
    per = F.col("program").startswith("per_system")
    tests = v.tests.select("model_idx", "tic", per.alias("per_system"), "inj_depth", "inj_duration", "partner_requested")
    source = campaign_source(v)
    ends = tests.agg(F.min("model_idx").alias("a"), F.max("model_idx").alias("z")).first()
    if ends["a"] is None:
        return chain.campaign(tests, source, chain.anywhere("chain.epoch"))
    middle = (ends["a"] + ends["z"] + 1) // 2
    bounds = [(lo, hi) for lo, hi in ((ends["a"], middle), (middle, ends["z"] + 1)) if lo < hi]
    plan = chain.planned(tests, source, "campaign")  # what does not depend on the range is worked out once
    return chain.run_ranges(plan, bounds, folder(v, "campaign"), lambda part: chain.carried_out(part, source, chain.anywhere("chain.epoch")), together=2)
