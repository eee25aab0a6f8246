"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipsift.operators.lineage import materialise

MIX = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string column; nulls are empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    flat = column.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], dtype=np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets, valid


def fresh(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores in front until no column (in any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished steps left: models and closures here; in the JVM
    their plans, broadcasts and shuffle files, which the context cleaner gives back once they are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short slices of a batch, so that what one step holds stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_bucket(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null keys fall in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(of)), F.lit(0)).cast("int")


def hash_share(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(rows: DataFrame, key: str, group: str, per_group: int, seed: int = 17) -> DataFrame:
    """About ``per_group`` rows of every group, chosen by a hash of ``key``.

    Groups are few (classes of a classifier).  Expected size is the bound; the
    chance of twice as many is negligible.  Rows without a group are left out."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    share = {r[group]: min(1.0, per_group / r["_n"]) for r in sizes.collect()}
    if not share:
        return rows.limit(0)
    keep = F.lit(False)
    for value, part in sorted(share.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(group) == F.lit(value)) & (hash_share(F.col(key), seed) < F.lit(part)))
    return rows.where(keep)


def weighted_sample(rows: DataFrame, values: list[str], group: str, per_group: int, seed: int = 17) -> DataFrame:
    """Distinct ``values`` of a bounded sample of the rows of every group: (group, values, ``weight``).

    A value that c of the n rows of its group have gets the weight c * per_group / n, rounded
    up or down by a hash of the value so that the expectation holds, and goes at 0; groups of up to
    ``per_group`` rows keep all their rows.  So a group weighs about ``per_group`` however few or
    frequent its values are, and no more rows than that are left of it."""
    counted = materialise(rows.where(F.col(group).isNotNull()).groupBy(group, *values).agg(F.count(F.lit(1)).alias("_n")), "counted")
    sizes = {r[group]: r["n"] for r in counted.groupBy(group).agg(F.sum("_n").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, per_group / n))).otherwise(share)
    # A whole share counts all rows, without rounding by the hash.
    weight = F.when(share == 1, F.col("_n").cast("double")).otherwise(
        F.floor(F.col("_n") * share + hash_share(F.struct(*values), seed)).cast("double"))
    return materialise(counted.withColumn("weight", weight).where("weight > 0").drop("_n"), "sample")
