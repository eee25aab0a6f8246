"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept; all but the last return the columns of ``documents``.
Null and empty texts go in the first stage; empty tables give empty tables at every stage; extra
columns pass through up to the last stage."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipsift.llm import decontaminate, jaccard_join, langid, packing, pii
from dipsift.llm.common import crc_bucket, fresh, release
from dipsift.llm.ship import ship
from dipsift.operators.lineage import scratch_dir

LEAST_SCORE = 0.4
ORACLE_SQL = None  # language models, alignment and tokenizers have no SQL form


def _begin(spark: SparkSession) -> None:
    """Every stage starts from files alone, so what the one before left in the driver is given back."""
    ship(spark)
    release(spark)


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays doubtful."""
    _begin(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    language, certainty = fresh(docs.columns, "_language"), fresh(docs.columns, "_certainty")
    model = langid.fit(docs.where((crc_bucket(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()))
    scored = langid.predict(docs, model, label_out=language, score_out=certainty)
    # Without any labelled row there is no model to reject by.
    kept = scored.where((F.col(language) != langid.UNKNOWN) & (F.col(certainty) >= LEAST_SCORE)) if model.labels else scored
    return kept.select(*_all(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of linked documents: the one with the smallest id.

    An id names a document: rows that repeat one are the same document and stay or go
    together.  Rows without an id stay."""
    _begin(spark)
    number = fresh(docs.columns, "_id")
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text")).select(F.col("doc_id").alias(number), "component_id")
    lesser = found.where(F.col(number) != F.col("component_id")).select(number).distinct()
    return docs.join(lesser, F.col("doc_id") == F.col(number), "left_anti").select(*_all(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, each row by its own text."""
    _begin(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets."""
    _begin(spark)
    # The row travels whole, so that no column of it can clash with those of the finder.
    rows = docs.select(F.struct(*_all(docs)).alias("row"), "text")
    found = pii.find(rows, pii.fit(rows)).select("row", pii.redacted(F.col("text"), F.col("spans")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens."""
    _begin(spark)
    return packing.sequences(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
