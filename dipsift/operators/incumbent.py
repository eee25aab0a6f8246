"""The model-comparison block attached to events, and record assembly."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import finite, lit
from dipsift.operators.hosts import keep_first


def incumbent_block(keys: DataFrame, comparator: DataFrame, order: str, key: str = "filename") -> DataFrame:
    """17 columns plus validity for every submitted key.  Absent or non-finite
    comparisons give a zero block with validity 0; a class outside the fixed nine
    fails the job.  The first comparator row per key wins, by its ingest
    position ``order``; a table without that column is refused."""
    if order not in comparator.columns:
        raise KeyError(f"comparator lacks its ingest order {order!r}")
    values = [*k.AIC_COLUMNS, *k.RMSE_COLUMNS]
    rows = keep_first(comparator.select(key, order, *values, "best_fit"), [key], [order]).drop(order)
    ok = F.lit(True)
    for c in values:
        ok = ok & finite(F.col(c))
    ok = F.coalesce(ok, F.lit(False))
    known = F.col("best_fit").isin(*k.BEST_FIT_CLASSES)
    checked = F.when(ok & ~F.coalesce(known, F.lit(False)),
                     F.raise_error(F.concat(F.lit("best_fit outside the fixed classes: "),
                                            F.coalesce("best_fit", F.lit("NULL"))))) \
        .otherwise(F.when(ok, 1).otherwise(0))
    best = F.least(*[F.col(c) for c in k.AIC_COLUMNS])
    j = keys.join(rows, key, "left").withColumn("incumbent_valid", checked.cast("int"))
    v = F.col("incumbent_valid") == 1
    cols = {f"delta_{c}": F.when(v, F.col(c) - best).otherwise(lit(0)) for c in k.AIC_COLUMNS}
    cols |= {c: F.when(v, F.col(c)).otherwise(lit(0)) for c in k.RMSE_COLUMNS}
    cols |= {f"best_fit_{c}": F.when(v & (F.col("best_fit") == c), lit(1)).otherwise(lit(0))
             for c in k.BEST_FIT_CLASSES}
    return j.select(*keys.columns, *[e.alias(n) for n, e in cols.items()], "incumbent_valid")


def event_scalars(events: DataFrame) -> DataFrame:
    """Model-ready scalars of an event that already carries its host columns
    (period, tmag, morph_coeff) and stack results (n_cycles_raw)."""
    return events.withColumns({
        "t_dur": F.col("duration"),
        "log_p_bin": F.log10("period"),
        "sin_phase": F.sin(lit(2 * math.pi) * F.col("phase")),
        "cos_phase": F.cos(lit(2 * math.pi) * F.col("phase")),
        "detrend_fraction": F.col("n_detrend_detections") / lit(k.DETREND_WINDOWS),
        "log1p_n_cycles": F.log1p(F.least(F.col("n_cycles_raw"), F.lit(k.CYCLE_CAP)).cast("double"))})


def validity_bits(df: DataFrame, pairs_admitted: bool = True,
                  columns: Sequence[str] = tuple(k.CONDITIONAL_SCALARS)) -> DataFrame:
    """``valid_<c>`` = 1 where the conditional scalar is defined; the pair scalars
    stay 0 until their gate has passed."""
    bits = {}
    for c in columns:
        gated = c in k.PAIR_SCALARS and not pairs_admitted
        bits[f"valid_{c}"] = F.lit(0) if gated else F.coalesce(
            finite(F.col(c).cast("double")).cast("int"), F.lit(0))
    return df.withColumns(bits)


def training_scalars() -> list[str]:
    names = k.CORE_SCALARS + k.INCUMBENT_COLUMNS + k.HOST_SCALARS + k.PAIR_SCALARS
    return [c for c in names if c not in k.WITHHELD_SCALARS]


def arm_columns(arm: str) -> list[str]:
    """Feature list of an arm: b0 the incumbent block, b everything offered,
    b_nopair without the pair scalars."""
    if arm == "b0":
        return list(k.INCUMBENT_COLUMNS)
    full = training_scalars()
    if arm == "b":
        return full
    if arm == "b_nopair":
        return [c for c in full if c not in k.PAIR_SCALARS]
    raise KeyError(f"unknown arm {arm!r}")


def gated_features(df: DataFrame, arm: str, extra: Sequence[str] = (),
                   features: Sequence[str] | None = None) -> DataFrame:
    """Projects exactly the arm's features (plus bookkeeping ``extra``).  Missing
    features, and audit or withheld columns among them, are refused when the plan
    is built."""
    feats = list(features) if features is not None else arm_columns(arm)
    missing = [c for c in feats if c not in df.columns]
    if missing:
        raise KeyError(f"arm {arm}: frame lacks {missing}")
    forbidden = sorted(set(feats) & (set(k.AUDIT_COLUMNS) | set(k.WITHHELD_SCALARS)))
    if forbidden:
        raise AssertionError(f"arm {arm}: forbidden columns {forbidden}")
    return df.select(*extra, *[F.col(c).cast("double").alias(c) for c in feats])
