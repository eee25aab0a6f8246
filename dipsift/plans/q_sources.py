"""Queries: scans, sinks, digests (S*), the feature gate and ranking models (P16, M*)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit
from dipsift.operators import evaluate, incumbent, models, probes, record, views
from dipsift.operators.lineage import materialise, scratch_dir
from dipsift.plans.q_clean import CIRC, eclipses
from dipsift.plans.q_eval import TAU
from dipsift.plans.q_views import INCUMBENT_SQL, LOCAL_SQL, local_pairs, records, repeated
from dipsift.plans.registry import query
from dipsift.sources import artifacts, curves


def folder(v, name: str) -> str:
    import uuid
    return f"{scratch_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def curve_folder(v, masked: bool = False) -> str:
    """The observations written as curve files, for the scans to read back."""
    path = folder(v, "curves")
    lc = v.lc
    if masked:
        from dipsift.functions.expr import in_eclipse
        from dipsift.operators import hosts
        lc = hosts.lookup(lc, v.host.select("tic", "prim_pos", "prim_width", "sec_pos", "sec_width"), ["event_id"]) \
            .withColumn("ecl_mask", in_eclipse(F.col("phase"), *eclipses()))
    curves.write_curves(lc, path, masked)
    return path


@query("s1_curve_scan", "SELECT tic, sector, time, flux, flux_err, phase, NULL AS ecl_mask FROM lc", "time flux flux_err phase")
def s1(v):
    return curves.scan_curves(v.spark, curve_folder(v))


@query("s1_masked_curve_scan", f"""SELECT l.tic, l.sector, l.time, l.flux,
  CASE WHEN coalesce({CIRC.format('l.phase', 'h.prim_pos')} <= h.prim_width / 2e0, false)
    OR coalesce({CIRC.format('l.phase', 'h.sec_pos')} <= h.sec_width / 2e0, false) THEN 1 ELSE 0 END AS masked
FROM lc l JOIN host h ON h.tic = l.tic""", "time flux")
def s1_masked(v):
    return curves.scan_curves(v.spark, curve_folder(v, True)).select(
        "tic", "sector", "time", "flux", F.col("ecl_mask").cast("int").alias("masked"))


EVENT_COLUMNS = ["TIC", "SECTOR", "TIME", "PHASE", "DEPTH", "DURATION", "SNR"]


@query("s2_event_table_scan", "SELECT tic, sector, event_time, phase, depth, duration, snr, 0 AS label, 0 AS inverted_lc FROM tce",
       "event_time phase depth duration snr")
def s2(v):
    path = folder(v, "events")
    cols = ["tic", "sector", "event_time", "phase", "depth", "duration", "snr"]
    v.tce.select(F.concat_ws("  ", *[F.col(c).cast("string") for c in cols]).alias("value")).write.text(path)
    return curves.scan_events(v.spark, path, EVENT_COLUMNS)


@query("s5_campaign_parts", "SELECT model_idx, tic, sector, event_id, event_time, depth FROM test_events", "event_time depth")
def s5(v):
    path = folder(v, "parts")
    v.test_events.select("model_idx", "tic", "sector", "event_id", "event_time", "depth").write.option("header", "true").csv(path)
    return curves.scan_parts(v.spark, path, "model_idx bigint, tic bigint, sector bigint, event_id bigint, event_time double, depth double")


@query("s6_snippet_store", f"""WITH {LOCAL_SQL}
SELECT event_id, count(*) AS n_samples, min(time) AS t_first, max(time) AS t_last, any_value(half) AS halfwidth FROM lp GROUP BY event_id""",
       "t_first t_last halfwidth")
def s6(v):
    path = folder(v, "snippets")
    ev = v.tce.select("tic", "sector", "event_id", "event_time", "duration")
    cad = v.lc.select("tic", "sector", "time", "flux", "flux_err", F.col("event_id").alias("cadence_id"))
    views.snippets(cad, ev, ["event_id"], ["cadence_id"]).write.parquet(path)
    return v.spark.read.parquet(path).select(
        "event_id", "n_samples", F.col("samples")[0]["time"].alias("t_first"),
        F.element_at("samples", -1)["time"].alias("t_last"), "halfwidth")


@query("s7_record_views")
def s7_views(v):
    """Dense [2, 201] and [2, 64] arrays of every event."""
    return record.build_views(v.lc, v.tce, v.host)


@query("s8_record_scan_systems", """SELECT tic, count(*) AS n FROM record WHERE tic IN (SELECT tic FROM host WHERE sec_width IS NULL) GROUP BY tic""")
def s8(v):
    path = folder(v, "records")
    artifacts.write_records(v.record.select("tic", "rec_id", "split", "rebalance_keep"), path)
    sealed = v.host.where(F.col("sec_width").isNull())
    return artifacts.read_records(v.spark, path, None, False, sealed).groupBy("tic").agg(F.count(lit(1)).alias("n"))


@query("s9_summary_json")
def s9(v):
    return artifacts.summary_json(evaluate.incumbent_points(v.record))


@query("s10_file_digests")
def s10(v):
    return artifacts.file_digests(v.spark, v.sf_dir, "*.parquet")


@query("s10_block_digests", """SELECT CAST(o_orderkey // 5000 AS BIGINT) AS block, sum(length(o_orderkey::VARCHAR || '|' || o_custkey || '|' || o_orderstatus) + 1)::BIGINT AS n_bytes,
  sha256(string_agg(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM orders GROUP BY ALL""")
def s10_blocks(v):
    """Digests of text files of 5,000 order numbers each; those above 32 KiB are hashed in blocks."""
    path = folder(v, "order-files")
    rows = v.table("orders").select(F.floor(F.col("o_orderkey") / 5000).cast("bigint").alias("block"), "o_orderkey",
                                    F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    (rows.repartition("block").sortWithinPartitions("block", "o_orderkey").select("block", "value")
     .write.partitionBy("block").text(path))
    found = artifacts.path_digests(v.spark, path, "part-*", 1 << 15, 1 << 13)
    return found.select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("bigint").alias("block"), "n_bytes", "sha256")


@query("s11_digest_gate", "SELECT count(*) AS n FROM orders")
def s11(v):
    found = artifacts.file_digests(v.spark, v.sf_dir, "*.parquet")
    recorded = materialise(found, "digests")
    return artifacts.digest_gate(v.table("orders").agg(F.count(lit(1)).alias("n")), found, recorded)


@query("s12_staging_inventory", """SELECT tic, sector, CASE WHEN sector > 3 THEN 'excluded' ELSE 'matched' END AS status
FROM (SELECT DISTINCT tic, sector FROM lc) WHERE tic IN (SELECT tic FROM host WHERE sec_width IS NOT NULL)""")
def s12(v):
    files = v.lc.select("tic", "sector").distinct().select(curves.curve_file_name(F.col("tic"), F.col("sector")).alias("file"))
    return curves.staging_inventory(files, v.host.where(F.col("sec_width").isNotNull()), 3).select("tic", "sector", "status")


@query("s13_unusable_files", """WITH n AS (SELECT tic, sector, count(*) AS n FROM lc GROUP BY tic, sector)
SELECT 'TIC_' || tic || '_' || lpad(sector::VARCHAR, 2, '0') || '.txt' AS file, n AS n_rows, 'one data row' AS reason FROM n WHERE n < 2""")
def s13(v):
    expected = v.lc.select(curves.curve_file_name(F.col("tic"), F.col("sector")).alias("file")).distinct()
    return curves.unusable_files(v.spark, curve_folder(v), expected, None)


@query("s14_masked_schema_check", """SELECT DISTINCT 'TIC_' || tic || '_' || lpad(sector::VARCHAR, 2, '0') || '.txt' AS file,
  4 AS min_columns, 4 AS max_columns FROM lc""")
def s14(v):
    return curves.schema_check(v.spark, curve_folder(v))


# --- gate and models ----------------------------------------------------------

FEATURES = ["depth", "t_dur", "snr", "detrend_fraction", "tmag", "score_base"]


def training(v) -> DataFrame:
    return v.record.where("rebalance_keep = 1").withColumns({
        "detrend_fraction": F.col("n_detrend_detections") / lit(k.DETREND_WINDOWS),
        "tmag": F.when(F.col("skye_flag").isNotNull(), F.col("price") / lit(1e3))})


@query("p16_feature_gate", f"WITH {INCUMBENT_SQL} SELECT filename, {', '.join(k.INCUMBENT_COLUMNS)} FROM inc", " ".join(k.INCUMBENT_COLUMNS))
def p16(v):
    block = incumbent.incumbent_block(v.record.select(F.col("rec_id").alias("filename")), repeated(v), "ingest")
    return incumbent.gated_features(block, "b0", extra=["filename"])


@query("m1_median_impute", """
WITH t AS (SELECT depth, t_dur, snr, n_detrend_detections / 21e0 AS detrend_fraction, CASE WHEN skye_flag IS NOT NULL THEN price / 1e3 END AS tmag, score_base
  FROM record WHERE rebalance_keep = 1 AND split = 'train')
SELECT 'depth' AS feature, median(depth) AS median FROM t UNION ALL SELECT 't_dur', median(t_dur) FROM t UNION ALL SELECT 'snr', median(snr) FROM t
UNION ALL SELECT 'detrend_fraction', median(detrend_fraction) FROM t UNION ALL SELECT 'tmag', median(tmag) FROM t UNION ALL SELECT 'score_base', median(score_base) FROM t""",
       "median")
def m1(v):
    return models.medians(training(v).where("split = 'train'"), FEATURES)


#: The limit of boosting rounds of M2 and M11 here; the library's default is 500. On these tables boosting gains for very
#: many rounds, and each is several Spark jobs. Systems kept from boosting may end it earlier. Other sizes are the defaults.
SIZES = {"group": "tic", "rounds": 20}


def grid(v, which=("logreg", "rf", "boosted")):
    t = training(v).select(*FEATURES, "label", "split", "tic", "rec_id")
    return models.fit_grid(t.where("split = 'train'"), t.where("split = 'val'"), FEATURES, which, **SIZES)


@query("m2_candidate_grid")
def m2(v):
    return grid(v)[0]


@query("m3_eight_feature_ranker")
def m3(v):
    from dipsift.operators import hosts, split
    host = v.host.select("tic", "period", "tmag", "morph_coeff")
    neg = v.tce.where("label = 0").select("tic", "event_id", "phase", "depth", "duration", "snr", "label", "n_detrend_detections")
    pos = v.tce.where("label = 1").select(*neg.columns)
    df = hosts.lookup(neg.unionByName(pos), host, ["event_id"]).withColumn("n_cycles_raw", F.lit(0))
    df = incumbent.event_scalars(df).select("tic", "label", *k.EIGHT_FEATURES)
    held = split.group_split(df.select("tic"), 0.2, "m3")
    df = materialise(df.join(held, "tic"), "eight-features")
    return models.fit_grid(df.where("held_out = 0"), df.where("held_out = 1"), k.EIGHT_FEATURES, ("logreg", "rf"), trees=500)[0]


def saved_ranker(v):
    """A fitted logistic ranker, its folder and the medians it was fitted with."""
    t = training(v).select(*FEATURES, "label", "split")
    train = materialise(models.dealt(t.where("split = 'train'")), "train-rows")
    fill = models.fit_medians(train, FEATURES)
    tr = materialise(models.dealt(models.balanced(models.imputed(train, FEATURES, fill)), train.count()), "train")
    model = models.candidates(FEATURES)["logreg"].fit(tr)
    path = folder(v, "ranker")
    model.write().save(path)
    return model, path, fill


@query("m4_gated_scoring")
def m4(v):
    _, path, fill = saved_ranker(v)
    found = artifacts.file_digests(v.spark, path)
    recorded = materialise(found, "ranker-digests")
    rows = artifacts.digest_gate(training(v), found, recorded)
    feats = incumbent.gated_features(rows, "b", extra=["rec_id", "tic"], features=FEATURES)
    assert len(FEATURES) == len(feats.columns) - 2
    return models.scored(PipelineModel.load(path), models.imputed(feats, FEATURES, fill)).select("rec_id", "tic", "score")


@query("m5_reproduction_gate")
def m5(v):
    first = materialise(grid(v, ("logreg",))[0], "recorded-metrics")
    return models.reproduces(grid(v, ("logreg",))[0], first, ["candidate"], ["average_precision", "roc_auc"], 1e-6)


@query("m7_provenance_probe")
def m7(v):
    return probes.provenance(training(v), FEATURES, group="tic")


def flat_views(v):
    return v.table("embeddings").select(F.col("label").alias("host"), F.col("embedding").alias("features"), "vec_id")


@query("m8_host_identity_probe")
def m8(v):
    return probes.host_identity(flat_views(v), "host", "features", "vec_id")


@query("m10_sealed_scoring")
def m10(v):
    model, _, fill = saved_ranker(v)
    sealed = v.host.where(F.col("sec_width").isNull()).select("tic")
    rows = training(v).join(sealed, "tic", "left_semi")
    path = folder(v, "sealed")
    scores = models.scored(model, models.imputed(rows, FEATURES, fill)).select("tic", "sector", "rec_id", "score")
    scores.write.mode("errorifexists").parquet(path)
    digest = artifacts.file_digests(v.spark, path, "*.parquet").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("digest"))
    cover = v.spark.read.parquet(path).groupBy("tic").agg(F.count(lit(1)).alias("n_scored"))
    return sealed.join(cover, "tic", "left").fillna(0, ["n_scored"]).withColumn("digest", digest.scalar())


@query("m11_ranking_ends", f"""
WITH s AS (SELECT rec_id, label, score FROM record WHERE split = 'val' AND rebalance_keep = 1)
SELECT avg(label) AS sample_rate, avg(CASE WHEN score < {TAU}e0 THEN 1e0 ELSE 0e0 END) AS outranked_share,
  (SELECT avg(label) FROM (SELECT label FROM s ORDER BY score DESC, rec_id LIMIT 200)) AS top_share,
  (SELECT avg(label) FROM (SELECT label FROM s ORDER BY score, rec_id DESC LIMIT 200)) AS bottom_share FROM s""",
       "sample_rate outranked_share top_share bottom_share")
def m11(v):
    return models.ends_of_ranking(v.record.where("split = 'val' and rebalance_keep = 1").select("rec_id", "label", "score"), 200, "rec_id", TAU)


@query("m11_feature_importance")
def m11_importance(v):
    _, fitted = grid(v, ("boosted",))
    columns = [*FEATURES, *[f"bit_{c}" for c in FEATURES]]
    return models.importances(fitted["boosted"], columns, v.record)
