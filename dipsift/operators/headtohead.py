"""Arms fitted, selected and compared on one record: from features to matched false positive rates.

Each arm is fitted on train and selected on validation rows; its chosen model scores the test rows once,
into one narrow written table, from which thresholds, counts, intervals and contrasts are taken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.operators import evaluate, models
from dipsift.operators.incumbent import gated_features
from dipsift.operators.lineage import materialise

BOOK = ["tic", "sector", *evaluate.FLAGS]
TOGETHER = 200_000  # train rows up to which all fits run side by side; changes the cost alone


def fit_arms(record: DataFrame, arms: Sequence[str], features: dict[str, Sequence[str]] | None = None,
             **sizes) -> dict[str, models.Fitted]:
    """Candidates of every arm, fitted on all kept train rows and judged on all kept validation rows.
    Systems never straddle the rows that end the boosting."""
    kept = materialise(record.where("rebalance_keep = 1"), "kept")
    lists = {}
    for arm in arms:
        gated = gated_features(kept, arm, features=(features or {}).get(arm))
        lists[arm] = gated.columns
    columns = dict.fromkeys(c for own in lists.values() for c in own)
    rows = kept.select("tic", "label", "split", *[F.col(c).cast("double").alias(c) for c in columns])
    return models.fit_candidates(rows.where("split = 'train'"), rows.where("split = 'val'"), lists, group="tic", together=TOGETHER, **sizes)


def test_scores(record: DataFrame, fitted: dict[str, models.Fitted]) -> DataFrame:
    """The test rows with the score of each arm's selected model: the narrow table of an evaluation, written once."""
    test = materialise(models.dealt(evaluate.flagged(evaluate.test_rows(record))), "test-rows")
    out = None
    for arm, f in fitted.items():
        rows = gated_features(test, arm, extra=BOOK, features=f.features)
        part = models.scored(f.models[f.selected], models.imputed(rows, f.features, f.fill)).select(F.lit(arm).alias("arm"), "score", *BOOK)
        out = part if out is None else out.unionByName(part)
    return materialise(out, "arm-scores")


def grid(fitted: dict[str, models.Fitted]) -> DataFrame:
    """(arm, candidate, quality on validation rows, selected) of all arms."""
    out = None
    for arm, f in fitted.items():
        part = f.table.withColumn("arm", F.lit(arm))
        out = part if out is None else out.unionByName(part)
    return out


def compare(scores: DataFrame, reference: str, n_resamples: int = 2000) -> DataFrame:
    """Per (arm, point, scope): false positives at matched recall with their bootstrap interval, recall at the
    incumbent's budget, and how many false positives fewer than ``reference`` has."""
    taus = evaluate.arm_thresholds(scores)
    matched = materialise(evaluate.matched_of(scores, taus), "matched")
    boot = evaluate.bootstrap_of(scores, n_resamples, thresholds=taus).select("arm", "point", "scope", "lo", "hi")
    budget = evaluate.budget_of(scores).select("arm", "point", "scope", "fp_budget", F.col("recall").alias("recall_at_budget"))
    cell = ["arm", "point", "scope"]
    other = matched.where(F.col("arm") == reference).select("point", "scope", F.col("fp").alias("_fp"))
    return (matched.join(boot, cell, "left").join(budget, cell, "left").join(other, ["point", "scope"], "left")
            .withColumn("contrast", F.col("_fp") - F.col("fp")).drop("_fp"))


def head_to_head(record: DataFrame, arms: Sequence[str], reference: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid, scores, comparison) of the arms."""
    fitted = fit_arms(record, arms, **options)
    scores = test_scores(record, fitted)
    chosen = grid(fitted).where("selected = 1").select("arm", F.col("candidate").alias("model"), F.col("average_precision").alias("val_average_precision"))
    return grid(fitted), scores, compare(scores, reference).join(F.broadcast(chosen), "arm")


