"""Queries over the assembled benchmark record (S7, P16, M6, M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import eclipse_edge_distance, finite, lit, uniform
from dipsift.operators import headtohead, hosts, incumbent, probes, record, sampling, views
from dipsift.operators.lineage import materialise
from dipsift.plans.fixtures import CLASS_LIST, pick, u_sql
from dipsift.plans.q_clean import EDGE_DISTANCE, eclipses
from dipsift.plans.q_sets import REBALANCE_SQL
from dipsift.plans.q_sources import folder
from dipsift.plans.q_views import FOLD_SQL, LOCAL_SQL, RECORD_COLUMNS, RECORD_SQL, records
from dipsift.plans.registry import query
from dipsift.sources import artifacts

COLUMNS = ["event_id", "label", "split", "rebalance_keep", *RECORD_COLUMNS[1:], "sin_phase", "cos_phase", "detrend_fraction",
           "incumbent_valid", *k.INCUMBENT_COLUMNS]
WHOLE = {"event_id", "label", "split", "rebalance_keep", "n_cycles_raw", "skye_flag", "incumbent_valid"}
DOUBLES = " ".join(c for c in COLUMNS if c not in WHOLE and not c.startswith("valid_"))

_head, _body = RECORD_SQL.split("\nSELECT t.event_id, t.snr", 1)
RECORD_7_SQL = f"""{_head}, rc AS (SELECT t.event_id, t.tic, t.label, sin(6.283185307179586e0 * t.phase) AS sin_phase,
  cos(6.283185307179586e0 * t.phase) AS cos_phase, t.n_detrend_detections / 21e0 AS detrend_fraction, t.snr{_body}),
cmp AS (SELECT event_id, {CLASS_LIST}[CAST(event_id % 9 AS INTEGER) + 1] AS best_fit, {", ".join(f"{u_sql(c, 'event_id')} * 1e2 AS {c}" for c in k.AIC_COLUMNS)},
  {", ".join(f"{u_sql(c, 'event_id')} * 1e-2 AS {c}" for c in k.RMSE_COLUMNS)} FROM tce WHERE event_id % 3 <> 0),
rcl AS (SELECT event_id AS doc_id, label, inverted_lc AS inverted FROM tce), {REBALANCE_SQL.replace('classes', 'rcl').format(s='', g='', p='', j='')},
whole AS (SELECT rc.*, CASE WHEN {u_sql('record.split', 'rc.tic')} < 0.7e0 THEN 'train' WHEN {u_sql('record.split', 'rc.tic')} < 0.85e0 THEN 'val' ELSE 'test' END AS split,
  rebalance_keep, CASE WHEN cmp.event_id IS NULL THEN 0 ELSE 1 END AS incumbent_valid,
  {", ".join([f"coalesce(cmp.{a} - least({', '.join('cmp.' + x for x in k.AIC_COLUMNS)}), 0e0) AS delta_{a}" for a in k.AIC_COLUMNS]
             + [f"coalesce(cmp.{a}, 0e0) AS {a}" for a in k.RMSE_COLUMNS]
             + [f"CASE WHEN cmp.best_fit = '{b}' THEN 1e0 ELSE 0e0 END AS best_fit_{b}" for b in k.BEST_FIT_CLASSES])}
  FROM rc LEFT JOIN cmp ON cmp.event_id = rc.event_id JOIN kept ON kept.doc_id = rc.event_id)"""


def whole_record(v):
    """Scalars, incumbent block, audit columns, rebalance flag and system split of every event."""
    e = F.col("event_id")
    compared = v.tce.where(e % 3 != 0).select(
        "event_id", F.lit(1).alias("ingest"), pick(k.BEST_FIT_CLASSES, e % 9).alias("best_fit"),
        *[(uniform(c, e) * lit(100)).alias(c) for c in k.AIC_COLUMNS], *[(uniform(c, e) * lit(1e-2)).alias(c) for c in k.RMSE_COLUMNS])
    u = uniform("record.split", F.col("tic"))
    split = F.when(u < lit(0.7), "train").when(u < lit(0.85), "val").otherwise("test")
    kept = sampling.rebalance(v.tce.select("event_id", "label", "inverted_lc"), "reb", "event_id", arm="inverted_lc").select("event_id", "rebalance_keep")
    return record.assemble(records(v), compared, "ingest", kept).withColumn("split", split)


def shard(v, splits=None, kept_only=True):
    path = folder(v, "records")
    artifacts.write_records(whole_record(v), path)
    return artifacts.read_records(v.spark, path, splits, kept_only)


@query("s7_record_shard", f"{RECORD_7_SQL} SELECT {', '.join(COLUMNS)} FROM whole WHERE rebalance_keep = 1 AND split IN ('train', 'val')", DOUBLES, 7)
def s7(v):
    return shard(v, ["train", "val"]).select(*COLUMNS)


ARRAYS_SQL = f"""WITH {LOCAL_SQL}, {FOLD_SQL},
lb AS (SELECT event_id, CAST(least(greatest(floor((time - event_time + half) / (half + half) * 201e0), 0), 200) AS INTEGER) AS bin, median(flux) - 1e0 AS value
  FROM lp GROUP BY ALL),
rb AS (SELECT event_id, CAST(least(greatest(floor((dphi + 1.5e0 * duration / period) / (1.5e0 * duration / period + 1.5e0 * duration / period) * 64e0), 0), 63) AS INTEGER) AS bin,
   median(level - 1e0) / any_value(denom) AS value, ln(1e0 + least(count(DISTINCT cycle), 60)) AS cycles FROM fs GROUP BY ALL)
SELECT event_id, channel, bin, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM (
  SELECT event_id, 'local_value' AS channel, bin, value FROM lb UNION ALL SELECT event_id, 'local_valid', bin, 1e0 FROM lb
  UNION ALL SELECT event_id, 'stack_value', bin, value FROM rb UNION ALL SELECT event_id, 'stack_cycles', bin, cycles FROM rb)
WHERE CAST(value AS FLOAT) <> 0"""


@query("s7_record_shard_arrays", ARRAYS_SQL, "value", 4)
def s7_arrays(v):
    """Both views of every event, from a shard that holds them beside scalars, incumbent block and flags."""
    path = folder(v, "shard")
    rows = whole_record(v).join(record.occupied_views(v.lc, v.tce, v.host), "event_id")
    artifacts.write_shard(rows, path, finish=lambda df: views.dense(df, record.VIEWS))
    rows = artifacts.read_shard(v.spark, path, kept_only=False)
    channels = F.array(*[F.struct(F.lit(name).alias("channel"), F.col(view)[i].alias("bins")) for view, i, name in (
        ("local", 0, "local_value"), ("local", 1, "local_valid"), ("recurrence", 0, "stack_value"), ("recurrence", 1, "stack_cycles"))])
    return (rows.select("event_id", F.explode(channels).alias("c")).select("event_id", "c.channel", F.posexplode("c.bins").alias("bin", "value"))
            .where("value <> 0").withColumn("value", F.col("value").cast("double")))


@query("s7_shard_attributes", f"{RECORD_7_SQL} SELECT count(*) AS n_events, {len(COLUMNS)} AS n_columns FROM whole")
def s7_attributes(v):
    path = folder(v, "shard")
    artifacts.write_shard(whole_record(v).select(*COLUMNS), path)
    about = artifacts.shard_attributes(v.spark, path)
    return about.select("n_events", F.size(F.split("columns", ",")).alias("n_columns"))


def arm(name: str):
    features = incumbent.arm_columns(name)

    @query(f"p16_arm_{name}", f"{RECORD_7_SQL} SELECT event_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in features)} FROM whole", " ".join(features), 7)
    def p16(v):
        return incumbent.gated_features(materialise(whole_record(v), "whole-record"), name, extra=["event_id"])


for _name in ("b0", "b", "b_nopair"):
    arm(_name)


# --- arms fitted and compared on the record -----------------------------------------

@query("a21_fitted_head_to_head")
def fitted_arms(v):
    """False positives at matched recall, intervals, recall at budget and contrast to the incumbent block
    of arms that are fitted, selected and scored here (A21-A24 on M2)."""
    record_ = materialise(whole_record(v), "whole-record")
    return headtohead.head_to_head(record_, ["b0", "b_nopair", "b"], "b0")[2]


# --- leak probes on the record -------------------------------------------------

SINGLE = [(3, "eclipse_phase_distance", False), (5, "log1p_n_cycles", False), (6, "gap_proximity", False), (7, "depth", True)]
#: Diagnostics, reported only: the pair scalars, and whether they are defined at all.
MORE = [(8 + i, c, True) for i, c in enumerate(k.PAIR_SCALARS)]
SCREENS = [(8 + len(MORE) + i, f"finite_{c}", True) for i, c in enumerate(["tmag", "skye_flag", "pair_dt_over_pbin"])]


def probe_rows(v):
    d = eclipse_edge_distance(F.col("phase"), *eclipses())
    near = hosts.lookup(v.tce, v.host.select("tic", "prim_pos", "prim_width", "sec_pos", "sec_width"), ["event_id"]).select(
        "event_id", d.alias("eclipse_phase_distance"))
    rows = whole_record(v).where("rebalance_keep = 1").join(near, "event_id")
    screens = {name: finite(F.col(name.removeprefix("finite_")).cast("double")).cast("double") for _, name, _ in SCREENS}
    return materialise(rows.withColumns({c: F.coalesce(x, lit(0)) for c, x in screens.items()}), "probe-record")


def probe_parts(v):
    return probes.single_columns(probe_rows(v), [*SINGLE, *MORE, *SCREENS])


PROBE_SQL = f"""{RECORD_7_SQL}, kp AS (SELECT w.*, {EDGE_DISTANCE} AS eclipse_phase_distance, CASE WHEN w.tmag IS NULL THEN 0e0 ELSE 1e0 END AS finite_tmag,
   CASE WHEN w.skye_flag IS NULL THEN 0e0 ELSE 1e0 END AS finite_skye_flag, CASE WHEN w.pair_dt_over_pbin IS NULL THEN 0e0 ELSE 1e0 END AS finite_pair_dt_over_pbin
  FROM whole w JOIN tce t ON t.event_id = w.event_id JOIN host h ON h.tic = t.tic WHERE w.rebalance_keep = 1)
""" + " UNION ALL ".join(
    f"""SELECT {number} AS probe, '{column}' AS name, CASE WHEN count({column}) < {k.PROBE_MIN_FINITE} OR count(DISTINCT label) FILTER (WHERE {column} IS NOT NULL) < 2
  THEN 0 ELSE count({column}) FILTER (WHERE split = 'val') END AS n, {'NULL::DOUBLE' if only else f'{k.GATE_AUC!r}::DOUBLE'} AS gate,
  CASE WHEN count({column}) < {k.PROBE_MIN_FINITE} OR count(DISTINCT label) FILTER (WHERE {column} IS NOT NULL) < 2 THEN 1 ELSE 0 END AS skipped FROM kp"""
    for number, column, only in [*SINGLE, *MORE, *SCREENS])


@query("m6_probe_inputs", PROBE_SQL, "gate")
def m6(v):
    """What the single-column probes were fitted and judged on; their metrics are in the report."""
    return probe_parts(v).select("probe", "name", "n", "gate", (F.col("verdict") == "SKIP").cast("int").alias("skipped"))


@query("m9_probe_report")
def m9(v):
    """Probes 1 to 7 and the reported diagnostics."""
    from dipsift.plans.q_sources import FEATURES, flat_views, training
    t = training(v)
    return probes.report(probes.balance_verdict(probes.inversion_balance(t, "label", "inverted_lc")), probes.provenance(t, FEATURES, group="tic"),
                         probes.host_identity(flat_views(v), "host", "features", "vec_id"), probe_parts(v))
