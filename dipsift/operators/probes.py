"""Leak probes: single quantities that must fail to predict the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import finite, lit, null_if_nan, uniform
from dipsift.operators.lineage import materialise
from dipsift.operators.models import balanced, dealt, scored, side_by_side, single_column_model
from dipsift.operators.rank import ranking_quality, top_by_count


def inversion_balance(df: DataFrame, label: str, flag: str, gate: float = k.GATE_INVERSION_DELTA) -> DataFrame:
    """Probe 1: difference of the flagged share between the classes."""
    pos, neg = F.col(label) == 1, F.col(label) == 0
    out = df.agg(F.avg(F.when(pos, F.col(flag))).alias("positive_rate"), F.avg(F.when(neg, F.col(flag))).alias("negative_rate"),
                 F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"))
    se = F.sqrt(lit(0.25) / F.nullif("n_pos", F.lit(0)) + lit(0.25) / F.nullif("n_neg", F.lit(0)))
    value = F.abs(F.col("positive_rate") - F.col("negative_rate"))
    return out.withColumns({"standard_error": se, "value": value}).withColumns({
        "passed": (F.col("value") <= lit(gate)).cast("int"),
        "underpowered": (lit(2) * F.col("standard_error") > lit(gate)).cast("int"),
        "probe": F.lit(1), "gate": lit(gate)})


def single_columns(df: DataFrame, specs: Sequence[tuple[int, str, bool]], train_value: str = "train", val_value: str = "val",
                   gate: float = k.GATE_AUC) -> DataFrame:
    """Probes 3, 5, 6, 7 and diagnostics: can one scalar alone predict the label on held-out
    systems?  ``df``: columns, label, split, read several times (written, at best); ``specs``: number, column, reported only.
    Too few finite values give no verdict.

    Counts of all columns are taken in one pass and all scores are judged in one, by probe."""
    x = {c: F.col(c).cast("double") for _, c, _ in specs}
    seen = {c: F.when(finite(x[c]), F.col("label")) for c in x}
    stat = df.agg(*[f.alias(f"{name}{i}") for i, c in enumerate(x) for name, f in (
        ("n", F.count_if(finite(x[c]))), ("a", F.min(seen[c])), ("z", F.max(seen[c])))]).first()
    at = {c: i for i, c in enumerate(x)}
    going = [(number, c) for number, c, _ in specs
             if stat[f"n{at[c]}"] >= k.PROBE_MIN_FINITE and stat[f"a{at[c]}"] != stat[f"z{at[c]}"]]

    def judged(spec: tuple[int, str]) -> DataFrame:
        rows = df.where(finite(x[spec[1]])).select(x[spec[1]].alias("x"), "label", "split")
        model = single_column_model("x").fit(balanced(rows.where(F.col("split") == train_value)))
        return scored(model, rows.where(F.col("split") == val_value)).select(F.lit(spec[0]).alias("probe"), "score", "label")
    names = df.sparkSession.createDataFrame([(n, c, only, (n, c) in going) for n, c, only in specs], "probe int, name string, only boolean, going boolean")
    if going:
        q = ranking_quality(report(*side_by_side(judged, going)), ["probe"], "score", "label").select("probe", "roc_auc", "auc_folded", "n")
        names = names.join(q, "probe", "left")
    else:
        names = names.withColumns({c: F.lit(None).cast("double") for c in ("roc_auc", "auc_folded")} | {"n": F.lit(0).cast("bigint")})
    verdict = F.when(F.col("roc_auc").isNull(), "SKIP").when(F.col("only"), "REPORTED").when(F.col("roc_auc") <= lit(gate), "PASS").otherwise("FAIL")
    return names.select("probe", "name", F.lit("val ROC-AUC").alias("metric"), F.col("roc_auc").alias("value"), F.col("auc_folded").alias("folded"),
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.when(~F.col("only"), lit(gate)).alias("gate"), verdict.alias("verdict"))


def single_column(df: DataFrame, probe: int, column: str, train_value: str = "train", val_value: str = "val",
                  reported_only: bool = False, gate: float = k.GATE_AUC) -> DataFrame:
    """One of :func:`single_columns`."""
    return single_columns(df, [(probe, column, reported_only)], train_value, val_value, gate)


def _verdict(probe: int, name: str, metric: str, value, folded, n, gate, reported_only: bool = False):
    gate_col = gate if not isinstance(gate, float) else lit(gate)
    passed = F.when(value.isNull(), "SKIP").when(F.lit(reported_only), "REPORTED") \
        .when(value <= gate_col, "PASS").otherwise("FAIL")
    return [F.lit(probe).alias("probe"), F.lit(name).alias("name"), F.lit(metric).alias("metric"), value.alias("value"),
            folded.alias("folded"), n.alias("n"), (F.lit(None).cast("double") if reported_only else gate_col).alias("gate"),
            passed.alias("verdict")]


def provenance(df: DataFrame, features: list[str], source: str = "label_source", rounds: int = 300,
               group: str | None = None, gate: float = k.GATE_AUC) -> DataFrame:
    """Probe 2: positives only, which generator made them?  ``df``: features,
    label, ``source`` (1 or 2 on positives), split.  With ``group``, a tenth of its values in train is
    kept from boosting and ends its rounds once it gains no more; ``rounds`` stays the limit."""
    stop = uniform("probe2", F.col(group)) < lit(0.1) if group else F.lit(False)
    pos = df.where(F.col("label") == 1).select(
        *[F.coalesce(null_if_nan(F.col(c).cast("double")), lit(0)).alias(c) for c in features],
        (F.col(source) == 2).cast("int").alias("label"), "split", stop.alias("_stop"))
    rows = materialise(dealt(pos), "probe-2")
    boosted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=4, seed=0, cacheNodeIds=True)
    if rows.where("split = 'train'").select("_stop").distinct().count() == 2:
        boosted = boosted.setValidationIndicatorCol("_stop")
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                             boosted]) \
        .fit(rows.where("split = 'train'"))
    q = ranking_quality(scored(model, rows.where("split = 'val'")), [], "score", "label")
    return q.select(*_verdict(2, "provenance", "val ROC-AUC", F.col("roc_auc"), F.col("auc_folded"), F.col("n"), gate))


def host_identity(views: DataFrame, key: str, features: str, row_key: str, top_n: int = 100, max_iter: int = 400) -> DataFrame:
    """Probe 4: can the flattened view alone name its system?  Gate is chance plus
    two standard errors.  ``features`` is a numeric array column."""
    top = top_by_count(views.select(key), key, top_n)
    rows = views.join(top.select(key), key, "left_semi").select(
        F.col(key).cast("string").alias("host"), array_to_vector(F.col(features).cast("array<double>")).alias("features"),
        uniform("probe4", F.col(row_key)).alias("_u"))
    rows = materialise(dealt(rows), "probe-4")
    index = StringIndexer(inputCol="host", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    rows = index.transform(rows)
    model = LogisticRegression(family="multinomial", maxIter=max_iter).fit(rows.where("_u < 0.75"))
    val = model.transform(rows.where("_u >= 0.75"))
    n_hosts = len(index.labels)
    chance = lit(1.0 / n_hosts)
    one = val.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    gate = chance + lit(2) * F.sqrt(chance * (lit(1) - chance) / F.greatest("n", F.lit(1)))
    return one.select(*_verdict(4, "host identity", "top-1 accuracy", F.col("v"), F.lit(None).cast("double"), F.col("n"), gate))


def report(*parts: DataFrame) -> DataFrame:
    """All probe verdicts in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def balance_verdict(balance: DataFrame) -> DataFrame:
    """Probe 1 in the report's shape."""
    return balance.select(*_verdict(1, "inversion balance", "abs class delta", F.col("value"), F.lit(None).cast("double"),
                                    F.col("n_pos") + F.col("n_neg"), k.GATE_INVERSION_DELTA))
