"""Arms from features to matched false positive rates, on a small record with known answers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from dipsift.functions.expr import uniform
from dipsift.operators import headtohead, models
from dipsift.plans import q_eval

ARMS = {"b": ["x", "y", "z"], "b_nopair": ["z", "y"]}
SMALL = {"trees": 20, "rounds": 20, "depth": 3}


@pytest.fixture(scope="module")
def record(spark):
    u = lambda name: uniform(name, F.col("id"))
    label = (u("label") < 0.4).cast("int")
    tic = F.floor(u("tic") * 60).cast("long")
    place = uniform("split", F.floor(u("tic") * 60).cast("long"))
    rows = spark.range(1500).select(
        "id", tic.alias("tic"), (F.col("id") % 4).alias("sector"), label.alias("label"), F.when(label == 1, 1).otherwise((u("src") < 0.2).cast("int")).alias("label_source"),
        F.when(place < 0.6, "train").when(place < 0.8, "val").otherwise("test").alias("split"), (u("keep") < 0.95).cast("int").alias("rebalance_keep"),
        (u("depth") * 0.004).alias("depth"), (u("dur") * 1.3).alias("t_dur"), (u("snr") * 20).alias("snr"), F.lit(20).alias("n_detrend_detections"),
        F.lit(0).alias("skye_flag"), F.when(u("fit") < 0.7, "T").otherwise("V").alias("best_fit"),
        (label + u("x") * 0.1).alias("x"), F.when(u("gone") < 0.9, u("y")).alias("y"), (label * 0.4 + u("z")).alias("z"))
    return spark.createDataFrame(rows.toPandas())


def test_selection_scores_and_counts(spark, record, tmp_path):
    fitted = headtohead.fit_arms(record, list(ARMS), features=ARMS, **SMALL)
    table = {(r.arm, r.candidate): r for r in headtohead.grid(fitted).collect()}
    assert table["b", "logreg"].roc_auc == pytest.approx(1) and 0.6 < table["b_nopair", "logreg"].roc_auc < 0.95
    for arm in ARMS:
        best = max((r for (a, _), r in table.items() if a == arm), key=lambda r: (r.average_precision, r.candidate))
        assert fitted[arm].selected == best.candidate and [r.selected for (a, c), r in table.items() if a == arm].count(1) == 1
    scores = headtohead.test_scores(record, fitted)
    n_test = record.where("split = 'test' AND rebalance_keep = 1").count()
    assert scores.count() == 2 * n_test and scores.columns[:2] == ["arm", "score"]
    out = headtohead.compare(scores, "b_nopair", n_resamples=200).toPandas().sort_values(["arm", "point", "scope"]).reset_index(drop=True)
    assert len(out) == 8 and (out[out.arm == "b"].fp == 0).all() and (out[out.arm == "b_nopair"].contrast == 0).all()
    assert (out.lo <= out.fp_per_1000 + 1e-9).all() and (out.hi >= out.fp_per_1000 - 1e-9).all()
    # The same counts in SQL over the written score table.
    scores.write.parquet(f"{tmp_path}/scores")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW scores AS SELECT * FROM read_parquet('{tmp_path}/scores/*.parquet')")
    sql = ("WITH te AS (SELECT * FROM scores WHERE arm = 'b'), m0 AS" + q_eval.TEST_SQL.split("m0 AS", 1)[1]
           + ", ar AS (SELECT *, score AS sc FROM scores), ps AS" + q_eval.matched_sql({"b": "score"}).split("ps AS", 1)[1])
    want = con.execute(f"{sql} SELECT arm, point, scope, base_recall, tau, fp, fp_per_1000, base_fp_per_1000, queue FROM mr").df()
    want = want.sort_values(["arm", "point", "scope"]).reset_index(drop=True)
    for c in want.columns:
        assert list(out[c]) == (pytest.approx(list(want[c])) if c not in ("arm", "point", "scope") else list(want[c]))


def test_copied_label_is_perfect_and_shuffled_label_is_chance(record):
    rows = record.withColumn("copy", F.col("label").cast("double")).withColumn("label", (uniform("shuffled", F.col("id")) < 0.4).cast("int"))
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    got = models.fit_candidates(train, val, {"noise": ["x", "y", "z"]}, group="tic", **SMALL)["noise"].table.collect()
    for r in got:  # standard error of the area under the curve under chance
        n, p = r.n - r.n_pos, r.n_pos
        assert abs(r.roc_auc - 0.5) < 2.5 * ((n + p + 1) / (12 * n * p)) ** 0.5
    rows = rows.withColumn("copy", F.col("label").cast("double"))
    perfect = models.fit_candidates(rows.where("split = 'train'"), rows.where("split = 'val'"), {"copy": ["copy"]}, fit_rows=300, **SMALL)["copy"].table.collect()
    assert all(r.roc_auc == pytest.approx(1) for r in perfect) and len(perfect) == 3
