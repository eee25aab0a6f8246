"""Ordered scans per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  Here
each key is cut into time shards; windows run inside (key, shard), one summary
row per shard is scanned across the key, and the summary is joined back on the
partitioning the rows already have.  Rows need non-null keys and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipsift.functions.expr import lit

SHARD_DAYS = 8.0  # a shard's summary row should stand for many rows; changes the cost alone


def _with_shard(df: DataFrame, at: str, width: float) -> DataFrame:
    return df.withColumn("_shard", F.floor(F.col(at) / lit(width)))


def with_neighbours(df: DataFrame, keys: Sequence[str], at: str,
                    carry: Sequence[str] = (), tie: Sequence[str] = (),
                    width: float = SHARD_DAYS) -> DataFrame:
    """Adds ``_prev`` and ``_next``: structs (at, *carry) of the adjacent rows of
    the same key in (at, *tie) order, NULL at the ends of the key."""
    cells = F.struct(at, *[c for c in carry if c != at])
    inner = Window.partitionBy(*keys, "_shard").orderBy(at, *tie)
    across = Window.partitionBy(*keys).orderBy("_shard")
    local = (_with_shard(df, at, width)
             .withColumn("_cells", cells)
             .withColumn("_prev", F.lag("_cells").over(inner))
             .withColumn("_next", F.lead("_cells").over(inner)))
    ends = (local.where(F.col("_prev").isNull() | F.col("_next").isNull())
            .groupBy(*keys, "_shard")
            .agg(F.first(F.when(F.col("_prev").isNull(), F.col("_cells")), True).alias("_head"),
                 F.first(F.when(F.col("_next").isNull(), F.col("_cells")), True).alias("_tail"))
            .select(*keys, "_shard",
                    F.lag("_tail").over(across).alias("_before"),
                    F.lead("_head").over(across).alias("_after")))
    return (local.join(ends, [*keys, "_shard"])
            .withColumn("_prev", F.coalesce("_prev", "_before"))
            .withColumn("_next", F.coalesce("_next", "_after"))
            .drop("_cells", "_before", "_after", "_shard"))


def running_total(df: DataFrame, keys: Sequence[str], at: str, value: Column, name: str,
                  tie: Sequence[str] = (), width: float = SHARD_DAYS) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and including the row."""
    inner = (Window.partitionBy(*keys, "_shard").orderBy(at, *tie)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    across = (Window.partitionBy(*keys).orderBy("_shard")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = _with_shard(df, at, width).withColumn("_value", value)
    before = (local.groupBy(*keys, "_shard").agg(F.sum("_value").alias("_total"))
              .select(*keys, "_shard",
                      F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before")))
    return (local.withColumn("_local", F.sum("_value").over(inner))
            .join(before, [*keys, "_shard"])
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_shard", "_value", "_local", "_before"))


def islands(df: DataFrame, keys: Sequence[str], at: str, gap: float, name: str = "island",
            tie: Sequence[str] = (), width: float = SHARD_DAYS) -> DataFrame:
    """Numbers runs of rows whose successive spacing stays within ``gap``: a new
    run starts where the spacing exceeds it.  Ids count from 0 per key.

    One summary row per shard (first time, last time, breaks inside) is enough:
    whether a shard's first row opens a run follows from the previous shard's
    last time."""
    t = F.col(at)
    inner = Window.partitionBy(*keys, "_shard").orderBy(at, *tie)
    across = Window.partitionBy(*keys).orderBy("_shard")
    local = _with_shard(df, at, width).withColumn(
        "_break", F.coalesce((t - F.lag(at).over(inner) > lit(gap)).cast("bigint"), F.lit(0)))
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(across) > lit(gap)).cast("bigint"), F.lit(0))
    heads = (local.groupBy(*keys, "_shard")
             .agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_break").alias("_inside"))
             .withColumn("_opens", opens)
             .select(*keys, "_shard", (F.sum("_opens").over(across) + F.coalesce(
                 F.sum("_inside").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                 .alias("_base")))
    run = F.sum("_break").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (local.withColumn("_run", run).join(heads, [*keys, "_shard"])
            .withColumn(name, F.col("_base") + F.col("_run"))
            .drop("_shard", "_break", "_run", "_base"))


def locate(points: DataFrame, queries: DataFrame, keys: Sequence[str], at: str,
           carry: Sequence[str] = (), width: float = SHARD_DAYS) -> DataFrame:
    """For every query row: how many points lie below / up to its ``at``, and the
    nearest point on each side, in one merge-ordered pass (no pairs are formed).

    Adds ``n_lt``, ``n_le``, ``n_points``, ``prev`` (last point <= at) and
    ``next`` (first point >= at); the structs hold (at, *carry)."""
    cells = F.struct(at, *[c for c in carry if c != at])
    p = points.select(*keys, F.col(at).alias("_at"), cells.alias("_p"))
    q = queries.select(*keys, F.col(at).alias("_at"), F.struct(*queries.columns).alias("_q"))
    merged = _with_shard(p.unionByName(q, allowMissingColumns=True), "_at", width)

    part = Window.partitionBy(*keys, "_shard")
    up, down = part.orderBy("_at"), part.orderBy(F.desc("_at"))
    local = (merged.withColumn("_le", F.count("_p").over(up))
                   .withColumn("_lo", F.max("_p").over(up))
                   .withColumn("_ge", F.count("_p").over(down))
                   .withColumn("_hi", F.min("_p").over(down))
                   .where(F.col("_q").isNotNull()))
    key = Window.partitionBy(*keys)
    left = key.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    right = key.orderBy(F.desc("_shard")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (merged.groupBy(*keys, "_shard")
               .agg(F.count("_p").alias("_n"), F.max("_p").alias("_max"),
                    F.min("_p").alias("_min"))
               .select(*keys, "_shard", "_n",
                       F.coalesce(F.sum("_n").over(left), F.lit(0)).alias("_nb"),
                       F.sum("_n").over(key).alias("_nt"),
                       F.max("_max").over(left).alias("_pb"),
                       F.min("_min").over(right).alias("_pa")))
    return (local.join(carried, [*keys, "_shard"])
            .select("_q.*",
                    (F.col("_nb") + F.col("_n") - F.col("_ge")).alias("n_lt"),
                    (F.col("_nb") + F.col("_le")).alias("n_le"),
                    F.col("_nt").alias("n_points"),
                    F.coalesce("_lo", "_pb").alias("prev"),
                    F.coalesce("_hi", "_pa").alias("next")))


def with_halo(df: DataFrame, at: str, reach: float, width: float) -> DataFrame:
    """Shards rows by time and copies each row into every shard within ``reach``
    of it, so a bounded frame over (key, ``_shard``) sees all its rows.  ``_core``
    marks the one copy that belongs to the shard."""
    t = F.col(at)
    return (df.withColumn("_shard", F.explode(F.sequence(
                F.floor((t - lit(reach)) / lit(width)), F.floor((t + lit(reach)) / lit(width)))))
              .withColumn("_core", F.col("_shard") == F.floor(t / lit(width))))
