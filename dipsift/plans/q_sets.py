"""Queries: set operations, reconciliation, splits and sampling (U*, S4, J12-J16, R*)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions import physics
from dipsift.functions.expr import lit, uniform
from dipsift.operators import campaign, hosts, sampling, sets, split, views
from dipsift.operators.lineage import materialise
from dipsift.plans import q_views
from dipsift.plans.fixtures import u_sql
from dipsift.plans.q_clean import EDGE_DISTANCE, EDGES_SQL, ORBIT_SQL
from dipsift.plans.q_eval import SYSTEM_SQL, normal_sql
from dipsift.plans.q_views import RECOVERY_SQL, labelled
from dipsift.plans.registry import query

PAIRS_SQL = """sp AS (SELECT DISTINCT tic, CAST(TRY_CAST(trim(tok) AS DOUBLE) AS BIGINT) AS sector
  FROM (SELECT tic, unnest(string_split(replace(sectors, ';', ','), ',')) AS tok FROM host)
  WHERE TRY_CAST(trim(tok) AS DOUBLE) IS NOT NULL)"""


@query("s4_sector_pairs", f"WITH {PAIRS_SQL} SELECT tic, sector FROM sp")
def s4(v):
    return hosts.sector_pairs(v.host)


@query("s3_catalogue_keep_first", """
SELECT o_custkey AS tic, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
WHERE r = 1""", "o_totalprice")
def s3(v):
    rows = v.table("orders").select(F.col("o_custkey").alias("tic"), "o_orderkey", "o_totalprice")
    return hosts.keep_first(rows, ["tic"], ["o_orderkey"])


@query("s15_product_inventory", """
SELECT o_custkey AS tic, count(DISTINCT month(o_orderdate)) AS n_sectors,
  list(DISTINCT month(o_orderdate) ORDER BY month(o_orderdate))::VARCHAR AS x,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, max(month(o_orderdate)) AS max_sector FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey
""".replace("  list(DISTINCT month(o_orderdate) ORDER BY month(o_orderdate))::VARCHAR AS x,\n", ""))
def s15(v):
    products = v.table("orders").select(F.col("o_custkey").alias("tic"), F.month("o_orderdate").cast("bigint").alias("sector"),
                                        F.col("o_orderstatus").alias("author"))
    done = v.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("tic"))
    return sets.product_inventory(products, done, {"F": "n_f", "O": "n_o", "P": "n_p"}).drop("sectors")


@query("s16_coverage_status", """
WITH p AS (SELECT o_custkey // 10 AS tic, month(o_orderdate) AS sector, bool_or(o_orderstatus = 'F') AS spoc, bool_or(o_orderstatus = 'O') AS qlp
   FROM orders GROUP BY ALL), h AS (SELECT DISTINCT tic, sector FROM lc),
n AS (SELECT p.*, h.tic IS NOT NULL AS have FROM p LEFT JOIN h ON h.tic = p.tic AND h.sector = p.sector)
SELECT tic, count(*) AS n_available, count(*) FILTER (WHERE have) AS n_cached, count(*) FILTER (WHERE NOT have AND spoc) AS n_new_spoc,
  count(*) FILTER (WHERE NOT have AND NOT spoc AND qlp) AS n_new_qlp, count(*) FILTER (WHERE NOT have AND NOT spoc AND NOT qlp) AS n_unfetched
FROM n GROUP BY tic""")
def s16(v):
    products = v.table("orders").select(F.floor(F.col("o_custkey") / 10).alias("tic"), F.month("o_orderdate").cast("bigint").alias("sector"),
                                        F.when(F.col("o_orderstatus") == "F", "spoc").when(F.col("o_orderstatus") == "O", "qlp")
                                        .otherwise("other").alias("author"))
    return sets.coverage_status(products, v.lc.select("tic", "sector").distinct(), ["spoc", "qlp"]).select(
        "tic", "n_available", "n_cached", "n_new_spoc", "n_new_qlp", "n_unfetched")


@query("j12_score_join", """
SELECT e.event_id, e.model_idx, t.program, t.inverted_lc FROM test_events e LEFT JOIN tests t ON t.model_idx = e.model_idx""")
def j12(v):
    return sets.many_to_one(v.test_events.select("event_id", "model_idx"), v.tests.select("model_idx", "program", "inverted_lc"),
                            ["model_idx"], ["event_id"])


SEALED = "SELECT tic FROM host WHERE sec_width IS NULL"


@query("j13_exclusion_and_seal", f"""
SELECT 'kept' AS part, count(*) AS n, count(DISTINCT tic) AS n_systems FROM tce WHERE tic NOT IN ({SEALED})
UNION ALL SELECT 'sealed', count(*), count(DISTINCT tic) FROM tce WHERE tic IN ({SEALED})""")
def j13(v):
    sealed = v.host.where(F.col("sec_width").isNull()).select("tic")
    stat = [F.count(lit(1)).alias("n"), F.countDistinct("tic").alias("n_systems")]
    kept, held = sets.excluding(v.tce, sealed, ["tic"]), sets.only(v.tce, sealed, ["tic"])
    return kept.agg(*stat).select(F.lit("kept").alias("part"), "*").unionByName(
        held.agg(*stat).select(F.lit("sealed").alias("part"), "*"))


@query("j14_expected_files", f"""WITH {PAIRS_SQL}
SELECT sp.tic, sp.sector, CASE WHEN EXISTS (SELECT 1 FROM lc WHERE lc.tic = sp.tic AND lc.sector = sp.sector) THEN 1 ELSE 0 END AS present FROM sp""")
def j14(v):
    return hosts.reconcile(hosts.sector_pairs(v.host), v.lc, ["tic", "sector"])


@query("j15_overlap_programs", f"""WITH {PAIRS_SQL},
o AS (SELECT t.*, CASE WHEN sp.tic IS NULL THEN 0 ELSE 1 END AS overlap FROM tests t LEFT JOIN sp ON sp.tic = t.tic AND sp.sector = t.sector)
SELECT overlap, count(*) AS n_tests, count(DISTINCT (tic, sector)) AS n_files,
  count(*) FILTER (WHERE overlap = 0 AND program LIKE 'per_system%') AS n_per_system_disjoint FROM o GROUP BY overlap""")
def j15(v):
    o = hosts.reconcile(v.tests, hosts.sector_pairs(v.host), ["tic", "sector"])
    return o.groupBy(F.col("present").alias("overlap")).agg(
        F.count(lit(1)).alias("n_tests"), F.countDistinct("tic", "sector").alias("n_files"),
        F.count_if((F.col("present") == 0) & F.col("program").startswith("per_system")).alias("n_per_system_disjoint"))


@query("j16_injection_plan", f"""
WITH f AS (SELECT DISTINCT tic, sector FROM lc),
n AS (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY sector) - 1 AS slot, count(*) OVER (PARTITION BY tic) AS n_tic,
   row_number() OVER (ORDER BY tic, sector) - 1 AS slot_all, count(*) OVER () AS n_all FROM f),
c AS (SELECT DISTINCT tic, n_tic FROM n)
SELECT t.model_idx, n.tic, n.sector FROM tests t JOIN c ON c.tic = t.tic JOIN n ON n.tic = t.tic AND n.slot = t.model_idx % c.n_tic
WHERE t.program LIKE 'per_system%'
UNION ALL SELECT t.model_idx, n.tic, n.sector FROM tests t
JOIN n ON n.slot_all = floor({u_sql('file', 't.model_idx')} * n.n_all) WHERE t.program NOT LIKE 'per_system%'""")
def j16(v):
    per = F.col("program").startswith("per_system")
    t = v.tests.select("model_idx", "tic", per.alias("per_system"))
    return campaign.injection_plan(t, v.lc.select("tic", "sector").distinct())


@query("u1_class_union", """
SELECT tic, sector, event_time, depth, duration, snr, 0 AS label, 'real_search' AS source FROM tce
WHERE snr >= 5e0 AND duration <= 1e0 AND n_detrend_detections > 18 AND coalesce(skye_flag, 0) = 0
UNION ALL SELECT tic, sector, event_time, depth, duration, snr, 1, 'bank_injection' FROM test_events WHERE snr >= 5e0 AND duration <= 1e0""",
       "event_time depth duration snr")
def u1(v):
    from dipsift.functions.expr import operating_point
    neg = v.tce.where(operating_point("A"))
    pos = v.test_events.where((F.col("snr") >= lit(5)) & (F.col("duration") <= lit(1)))
    return sets.class_union(neg, pos, ["tic", "sector", "event_time", "depth", "duration", "snr"])


@query("u2_membership_check", """
SELECT 'both' AS side, tic FROM (SELECT tic FROM host INTERSECT SELECT tic FROM record)
UNION ALL SELECT 'left_only', tic FROM (SELECT tic FROM host EXCEPT SELECT tic FROM record)
UNION ALL SELECT 'right_only', tic FROM (SELECT tic FROM record EXCEPT SELECT tic FROM host)""")
def u2(v):
    return sets.membership(v.host.select("tic"), v.record.select("tic"))


@query("u3_append_exclusions", """
WITH e AS (SELECT DISTINCT l_suppkey AS tic, 'old' AS reason FROM lineitem WHERE l_quantity > 45),
n AS (SELECT DISTINCT user_id AS tic, 'new' AS reason FROM events WHERE event_type = 'error')
SELECT * FROM e UNION ALL SELECT * FROM n WHERE tic NOT IN (SELECT tic FROM e)""")
def u3(v):
    old = v.table("lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("tic")).distinct().withColumn("reason", F.lit("old"))
    new = v.table("events").where("event_type = 'error'").select(F.col("user_id").alias("tic")).distinct().withColumn("reason", F.lit("new"))
    return sets.append_new(old, new, ["tic"])


@query("u4_catalogue_sectors", f"""WITH {PAIRS_SQL}
SELECT l.tic, count(DISTINCT l.sector) AS n_sectors, count(*) AS n_cadences, min(time) AS t_min, max(time) AS t_max
FROM lc l SEMI JOIN sp ON sp.tic = l.tic AND sp.sector = l.sector GROUP BY l.tic""", "t_min t_max")
def u4(v):
    return sets.only(v.lc, hosts.sector_pairs(v.host), ["tic", "sector"]).groupBy("tic").agg(
        F.countDistinct("sector").alias("n_sectors"), F.count(lit(1)).alias("n_cadences"), F.min("time").alias("t_min"), F.max("time").alias("t_max"))


# --- splits -------------------------------------------------------------------

@query("r6_group_split", f"""
WITH s AS (SELECT tic, {u_sql('group', 'tic')} AS u FROM (SELECT DISTINCT tic FROM record))
SELECT tic, CASE WHEN row_number() OVER (ORDER BY u) <= ceil(0.25e0 * count(*) OVER ()) THEN 1 ELSE 0 END AS held_out FROM s""")
def r6(v):
    return split.group_split(v.record.select("tic"), 0.25, "group")


PINNED = [3, 7, 11]


def inverse_sql(index, base):
    return "(" + " + ".join(f"(floor(({index}) / {float(base ** j)!r}) % {base}) / {float(base) ** (j + 1)!r}"
                            for j in range(math.ceil(53 / math.log2(base)))) + ")"


SPLIT_SQL = f"""placed AS (SELECT tic, stratum, CASE WHEN stratum LIKE '10plus%' THEN 0.6e0 ELSE 0.7e0 END AS g,
    {inverse_sql('row_number() OVER (PARTITION BY stratum ORDER BY n_events DESC, tic) - 1', 2)} AS u FROM sysx WHERE tic NOT IN (3, 7, 11)),
assigned AS (SELECT tic, stratum, CASE WHEN u < g THEN 'train' WHEN u < g + 0.15e0 THEN 'val' ELSE 'test' END AS split FROM placed
  UNION ALL SELECT tic, stratum, 'test' FROM sysx WHERE tic IN (3, 7, 11))"""


def systems(v):
    return split.system_table(v.record, v.host)


@query("r7_stratified_split", f"WITH {SYSTEM_SQL}, {SPLIT_SQL} SELECT tic, stratum, split FROM assigned")
def r7(v):
    return split.stratified_split(systems(v), PINNED)


@query("r8_split_verification", f"WITH {SYSTEM_SQL} SELECT 'x' AS kind, tic FROM sysx WHERE false")
def r8(v):
    done = materialise(split.stratified_split(systems(v), PINNED), "split-map")
    rows = v.record.drop("split").join(done.select("tic", "split"), "tic", "left")
    return split.split_violations(rows, done, PINNED)


@query("r8_split_corruption", "SELECT DISTINCT 'row disagrees with the map' AS kind, tic FROM record WHERE label = 1 AND split <> 'val'")
def r8_corrupt(v):
    m = v.record.select("tic", "split").distinct()
    bad = v.record.withColumn("split", F.when(F.col("label") == 1, "val").otherwise(F.col("split")))
    return split.split_violations(bad, m)


# --- sampling -----------------------------------------------------------------

REBALANCE_SQL = f"""t AS (SELECT avg(inverted) AS t FROM classes WHERE label = 1),
q AS (SELECT {{s}} count(*) FILTER (WHERE inverted = 1) AS inv, count(*) FILTER (WHERE inverted = 0) AS nat FROM classes WHERE label = 0 {{g}}),
r AS (SELECT c.*, row_number() OVER (PARTITION BY {{p}} c.inverted ORDER BY {u_sql('reb', 'c.doc_id')}) AS i, q.inv, q.nat, t.t
  FROM classes c, t, q WHERE c.label = 0 {{j}}),
kept AS (SELECT doc_id, CASE WHEN inv = 0 OR nat = 0 OR t IS NULL THEN 1
    WHEN inv > (CASE WHEN t < 1 THEN floor(nat * t / (1e0 - t)) ELSE inv END) THEN CASE WHEN inverted = 0 OR i <= floor(nat * t / (1e0 - t)) THEN 1 ELSE 0 END
    WHEN nat > (CASE WHEN t > 0 THEN floor(inv * (1e0 - t) / t) ELSE nat END) THEN CASE WHEN inverted = 1 OR i <= floor(inv * (1e0 - t) / t) THEN 1 ELSE 0 END
    ELSE 1 END AS rebalance_keep FROM r UNION ALL SELECT doc_id, 1 FROM classes WHERE label = 1)"""


@query("r1_rebalance", "WITH " + REBALANCE_SQL.format(s="", g="", p="", j="") + " SELECT * FROM kept")
def r1(v):
    return sampling.rebalance(v.classes, "reb", "doc_id").select("doc_id", "rebalance_keep")


@query("r1_rebalance_stratified", "WITH holes AS (SELECT * REPLACE (nullif(stratum, 'src3') AS stratum) FROM classes), "
       + REBALANCE_SQL.replace("classes", "holes").format(s="stratum,", g="GROUP BY stratum", p="c.stratum,", j="AND q.stratum IS NOT DISTINCT FROM c.stratum")
       + " SELECT * FROM kept")
def r1_strata(v):
    """One stratum is NULL."""
    holes = v.classes.withColumn("stratum", F.nullif("stratum", F.lit("src3")))
    return sampling.rebalance(holes, "reb", "doc_id", ["stratum"]).select("doc_id", "rebalance_keep")


@query("r1_rebalance_report", "WITH " + REBALANCE_SQL.format(s="", g="", p="", j="") + """,
f AS (SELECT c.*, k.rebalance_keep FROM classes c JOIN kept k ON k.doc_id = c.doc_id),
a AS (SELECT avg(inverted) FILTER (WHERE label = 1) AS positive_rate, count(*) FILTER (WHERE label = 0) AS negatives_before,
  count(*) FILTER (WHERE label = 0 AND rebalance_keep = 1) AS negatives_after, avg(inverted) FILTER (WHERE label = 0) AS rate_before,
  avg(inverted) FILTER (WHERE label = 0 AND rebalance_keep = 1) AS rate_after FROM f)
SELECT *, abs(positive_rate - rate_before) AS gap_before, abs(positive_rate - rate_after) AS gap_after FROM a""",
       "positive_rate rate_before rate_after gap_before gap_after")
def r1_report(v):
    return sampling.rebalance_report(sampling.rebalance(v.classes, "reb", "doc_id"))


@query("r2_even_mix", f"""
WITH s AS (SELECT * FROM tests WHERE program = 'secondary_all63'),
r AS (SELECT *, row_number() OVER (PARTITION BY inverted_lc ORDER BY {u_sql('mix', 'model_idx')}) AS i FROM s),
n AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM s GROUP BY inverted_lc))
SELECT model_idx, inverted_lc FROM r, n WHERE i <= c""")
def r2(v):
    return sampling.even_mix(v.tests.where("program = 'secondary_all63'"), "mix", "model_idx", "inverted_lc").select("model_idx", "inverted_lc")


@query("r3_positive_cap", f"""
WITH c AS (SELECT doc_id, 1 - label AS label FROM classes UNION ALL SELECT doc_id + 1000000000, 1 FROM classes),
n AS (SELECT floor(3e0 * count(*)) AS k FROM c WHERE label = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {u_sql('cap', 'doc_id')}) AS i FROM c)
SELECT doc_id, label FROM r, n WHERE label = 0 OR i <= k""")
def r3(v):
    c = v.classes.select("doc_id", (1 - F.col("label")).alias("label"))
    return sampling.cap_positives(c.unionByName(v.classes.select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit(1).alias("label"))),
                                  "cap", "doc_id", ratio=3.0).select("doc_id", "label")


LOG_RATIOS = [math.log10(pp / pb) for pb, pp, _ in k.OBSERVED_SPACINGS]
RATIOS = [s / pb for pb, _, s in k.OBSERVED_SPACINGS]
WEIGHT = [f"exp(-0.5e0 * pow(({x!r} - lx) / 0.3e0, 2))" for x in LOG_RATIOS]
DRAW_SQL = ORBIT_SQL.rstrip() + f""", d0 AS (SELECT t.model_idx, t.inj_duration, o.period, o.ecc, coalesce(o.sec_depth / o.prim_depth, 1e0) AS hr,
   o.p_crit * pow(10e0, {u_sql('draw.pp', 't.model_idx')} * CASE WHEN {u_sql('draw.tail', 't.model_idx')} < 0.2e0 THEN 1e0 ELSE {math.log10(3.0)!r} END) AS p_planet
  FROM tests t JOIN o ON o.tic = t.tic),
d1 AS (SELECT *, log10(p_planet / period) AS lx FROM d0),
d2 AS (SELECT *, [{', '.join(WEIGHT)}] AS w, {u_sql('draw.row', 'model_idx')} AS ur FROM d1),
d3 AS (SELECT *, list_sum(w) AS tw FROM d2),
d4 AS (SELECT *, CASE {' '.join(f"WHEN ur * tw < {' + '.join(f'w[{j + 1}]' for j in range(i + 1))} THEN {RATIOS[i]!r}" for i in range(12))} ELSE {RATIOS[-1]!r} END AS rr FROM d3),
d5 AS (SELECT *, rr * exp(0.05e0 * {normal_sql('draw.jit', 'model_idx')}) AS ratio, greatest(0.15e0, inj_duration) AS lo, 0.5e0 * period AS hi FROM d4)
SELECT model_idx, p_planet, CASE WHEN hi > lo THEN least(greatest(ratio * period, lo), hi)
   * CASE WHEN {u_sql('draw.sign', 'model_idx')} < 0.5e0 THEN -1e0 ELSE 1e0 END END AS partner_dt,
 least(greatest(hr * ([{', '.join(repr(x) for x in k.DEPTH_FACTOR_QUANTILES)}]::DOUBLE[])[CAST(floor({u_sql('draw.g', 'model_idx')} * 40e0) AS INT) + 1]
   * exp(0.2e0 * {normal_sql('draw.gj', 'model_idx')}), 1e-3), 2e0) AS partner_ratio,
 least(greatest(([{', '.join(repr(x) for x in k.DURATION_RATIO_QUANTILES)}]::DOUBLE[])[CAST(floor({u_sql('draw.q', 'model_idx')} * 25e0) AS INT) + 1]
   * exp(0.15e0 * {normal_sql('draw.qj', 'model_idx')}), 2e-2), 1e0) AS partner_duration_ratio FROM d5"""


@query("r10_partner_draws", DRAW_SQL, "p_planet partner_dt partner_ratio partner_duration_ratio", 7)
def r10(v):
    key = F.col("model_idx")
    h = hosts.orbit_columns(v.host).select("tic", "period", "p_crit", F.coalesce(F.col("sec_depth") / F.col("prim_depth"), lit(1)).alias("hr"))
    t = hosts.lookup(v.tests.select("model_idx", "tic", "inj_duration"), h, ["model_idx"]).where("host_found = 1")
    t = t.withColumn("p_planet", physics.planet_period(F.col("p_crit"), "draw", key))
    drawn = sampling.with_partner_draws(t, "draw", "model_idx", duration="inj_duration", host_ratio="hr")
    return drawn.select("model_idx", "p_planet", "partner_dt", "partner_ratio", "partner_duration_ratio")


@query("r12_design_table", f"""
SELECT o_orderkey, pow(10e0, -3e0 + {inverse_sql('o_orderkey', 2)} * ({math.log10(1.5e-2)!r} + 3e0)) AS depth, 0.05e0 + {inverse_sql('o_orderkey', 3)} * 0.95e0 AS duration,
  {inverse_sql('o_orderkey', 5)} * 0.9e0 AS impact, 0.2e0 + {inverse_sql('o_orderkey', 7)} * 0.3e0 AS u1, 0.1e0 + {inverse_sql('o_orderkey', 11)} * 0.2e0 AS u2,
  CASE WHEN {inverse_sql('o_orderkey', 13)} < 0.3e0 THEN 0.1e0 + {inverse_sql('o_orderkey', 13)} / 0.3e0 * 0.2e0 ELSE 0e0 END AS warp FROM orders""",
       "depth duration impact u1 u2 warp")
def r12(v):
    return sampling.design_points(v.table("orders"), "o_orderkey")


CYCLES_SQL = f"""c AS (SELECT t.event_id, floor((l.time - t.event_time) / h.period + 0.5e0) AS cycle, count(*) AS n
  FROM tce t JOIN host h ON h.tic = t.tic JOIN lc l ON l.tic = t.tic AND abs(l.time - t.event_time) > greatest(3e0 * t.duration, 0.75e0)
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {u_sql('cyc', 'event_id', 'CAST(cycle AS BIGINT)')}, cycle) AS i FROM c WHERE cycle <> 0),
chosen AS (SELECT event_id, CAST(cycle AS BIGINT) AS cycle, n AS n_cadences, CASE WHEN i <= 1 + event_id % 5 THEN 1 ELSE 0 END AS kept FROM r)"""


def chosen(v):
    ev = hosts.lookup(v.tce, v.ephemeris, ["event_id"]).select("tic", "event_id", "event_time", "duration", "period")
    return sampling.chosen_cycles(v.lc, ev, 1 + F.col("event_id") % 5, "cyc")


@query("r9_cycle_subsample", f"WITH {CYCLES_SQL} SELECT * FROM chosen")
def r9(v):
    return chosen(v).select("event_id", "cycle", "n_cadences", "kept")


CAP_SQL = """ AND (abs(time - event_time) <= greatest(3e0 * duration, 0.75e0) OR floor((time - event_time) / period + 0.5e0) = 0
  OR EXISTS (SELECT 1 FROM chosen k WHERE k.kept = 1 AND k.event_id = fb.event_id AND k.cycle = floor((fb.time - fb.event_time) / fb.period + 0.5e0)))"""


@query("r9_capped_scalars", f"WITH {q_views.LOCAL_SQL}, {CYCLES_SQL}, {q_views.fold_sql(CAP_SQL)} SELECT * FROM recur",
       "rec_depth_med rec_depth_mad rec_frac_dipping")
def r9_capped(v):
    """Stack summary of events that see only their budget of other cycles."""
    return views.recurrence_scalars(q_views.stack(v, sampling.cycle_caps(chosen(v))), ["event_id"])
