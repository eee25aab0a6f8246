"""Stage boundaries of multi-step operators.

``materialise`` writes a table once to the shared folder and reads it back, so
later steps start from files instead of a repeated (and, after an executor is
lost, recomputed) plan.  Files are columnar: later steps still prune columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for local sessions."""
    configured = spark.conf.get(SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(SETTING, made)
    return made


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
