"""Record shards, digests and summaries."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Callable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipsift.functions.expr import finite
from dipsift.operators.lineage import materialise


WHOLE_BELOW = 64 << 20
BLOCK = 4 << 20
DIGEST_SCHEMA = "path string, n_bytes bigint, sha256 string"


def _hash_in_blocks(block: int):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inside = fs.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", path), safe="/:@"))
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(inside) as stream:
                    while part := stream.read(block):
                        digest.update(part)
                        size += len(part)
                yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})
    return run


def path_digests(spark: SparkSession, path: str, pattern: str = "*", whole_below: int = WHOLE_BELOW,
                 block: int = BLOCK) -> DataFrame:
    """SHA-256 and size of every file below ``path``, by full path.

    Files up to ``whole_below`` bytes are values of Spark's reader, which opens every
    file system that the session knows.  Larger ones are listed only, without content,
    and their task hashes them in blocks, so no file is held whole and none is too
    large; they must lie on a file system that Arrow opens.  Partitions follow file
    sizes in both, without a shuffle.  Spark's readers skip files without bytes, so
    those have no row."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(path))
    small = files.where(F.col("length") <= whole_below).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_below).select("path").mapInArrow(_hash_in_blocks(block), DIGEST_SCHEMA)
    return small.unionByName(large)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """:func:`path_digests` by the place below ``path``: the file name, with its folders if it lies deeper, as
    part files of several tables bear equal names."""
    return path_digests(spark, path, pattern).select(_below(path).alias("file"), "n_bytes", "sha256")


def _below(root: str):
    inside = posixpath.normpath(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)).strip("/")
    bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    # Spark makes a relative root absolute, so the root may stand behind other folders; those are alike in all files.
    at = F.lit(0) if inside in ("", ".") else F.instr(bare, f"/{inside}/")
    start = F.when(at > 0, at + len(inside) + 2).otherwise(F.lit(1))
    return F.ltrim(F.substring(bare, start, F.length(bare)), F.lit("/"))


def digest_mismatches(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that changed, vanished or were never recorded."""
    a = found.select("file", F.col("sha256").alias("found"))
    b = recorded.select("file", F.col("sha256").alias("recorded"))
    kind = F.when(F.col("recorded").isNull(), "unrecorded").when(F.col("found").isNull(), "missing").otherwise("changed")
    return (a.join(b, "file", "full_outer").where(~F.col("found").eqNullSafe(F.col("recorded")))
            .select("file", kind.alias("problem")))


def digest_gate(rows: DataFrame, found: DataFrame, recorded: DataFrame) -> DataFrame:
    """``rows`` unchanged, or a failing job when any digest disagrees."""
    bad = digest_mismatches(found, recorded).select(F.count(F.lit(1))).scalar()
    return rows.where(F.when(bad > 0, F.raise_error(F.lit("input digests differ from the record"))).otherwise(F.lit(True)))


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.write.mode(mode).partitionBy("split").parquet(path)


def record_attributes(records: DataFrame) -> DataFrame:
    """The shard's one-row description."""
    return records.agg(F.count(F.lit(1)).alias("n_events")).withColumn("columns", F.lit(",".join(records.columns)))


def write_shard(records: DataFrame, path: str, mode: str = "errorifexists",
                finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Scalars, flags and nested arrays of the records together with the shard's one-row
    description: one write, so that a reader finds both or neither.  The rows are
    computed once, for the count and for the files.  ``finish`` works on them as they are written
    (same rows, same names), so that wide arrays are written once."""
    rows = materialise(records, "shard-rows")
    about = record_attributes(rows).select(F.struct("n_events", "columns").alias("shard_attributes"))
    done = rows if finish is None else finish(rows)
    (done.withColumn("shard_part", F.lit("records"))
     .unionByName(about.withColumn("shard_part", F.lit("attributes")), allowMissingColumns=True)
     .write.mode(mode).partitionBy("shard_part", "split").parquet(path))


def read_shard(spark: SparkSession, path: str, splits: Sequence[str] | None = None, kept_only: bool = True) -> DataFrame:
    """Rows of :func:`write_shard`; arrays that are not selected are not read."""
    return read_records(spark, f"{path}/shard_part=records", splits, kept_only).drop("shard_attributes")


def shard_attributes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/shard_part=attributes").select("shard_attributes.*")


def read_records(spark: SparkSession, path: str, splits: Sequence[str] | None = None, kept_only: bool = True,
                 systems: DataFrame | None = None) -> DataFrame:
    """Shard rows; the split predicate prunes partitions, the rest is pushed down."""
    df = spark.read.parquet(path)
    if splits is not None:
        df = df.where(F.col("split").isin(*splits))
    if kept_only:
        df = df.where("rebalance_keep = 1")
    return df if systems is None else df.join(systems.select("tic").distinct(), "tic", "left_semi")


def summary_json(row: DataFrame) -> DataFrame:
    """A one-row table as one JSON text; NaN and infinities become null."""
    clean = [F.when(finite(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
             for c, t in row.dtypes]
    return row.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("summary"))
