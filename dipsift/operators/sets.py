"""Set operations, guarded joins and coverage inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.operators.skew import attach


def excluding(rows: DataFrame, banned: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(banned.select(*keys).distinct(), list(keys), "left_anti")


def only(rows: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def many_to_one(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Left join that fails the job when ``table`` repeats a key or a row finds none."""
    cols = [c for c in table.columns if c not in keys]
    unique = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols])
    unique = unique.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("join key repeats in the table"))).otherwise(1))
    joined = attach(rows, unique, keys, spread)
    checked = F.when(F.col("_ok").isNull(), F.raise_error(F.lit("row without a match"))).otherwise(F.col("_ok"))
    return joined.where(checked == 1).drop("_ok", "_n")


def class_union(negatives: DataFrame, positives: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both classes with the same columns, label and provenance."""
    n = negatives.select(*columns, F.lit(0).alias("label"), F.lit("real_search").alias("source"))
    p = positives.select(*columns, F.lit(1).alias("label"), F.lit("bank_injection").alias("source"))
    return n.unionByName(p)


def membership(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct keys by side: both, left_only, right_only."""
    key = left.columns[0]
    both = (left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
            .unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
            .groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r")))
    side = F.when(F.col("_l") + F.col("_r") == 2, "both").when(F.col("_l") == 1, "left_only").otherwise("right_only")
    return both.select(side.alias("side"), key)


def append_new(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows untouched, plus the rows whose key they do not hold."""
    return existing.unionByName(rows.join(existing.select(*keys).distinct(), list(keys), "left_anti"))


def product_inventory(products: DataFrame, done: DataFrame, authors: dict[str, str]) -> DataFrame:
    """Per system not yet done: distinct sectors, products per author, last sector.
    A product row with a NULL sector marks a failed lookup: -1 sectors."""
    todo = excluding(products, done, ["tic"])
    failed = F.count_if(F.col("sector").isNull()) > 0
    return todo.groupBy("tic").agg(
        F.when(failed, F.lit(-1).cast("bigint")).otherwise(F.countDistinct("sector")).alias("n_sectors"),
        F.array_sort(F.collect_set("sector")).alias("sectors"),
        *[F.count_if(F.col("author") == a).alias(n) for a, n in authors.items()],
        F.coalesce(F.max("sector"), F.lit(0)).alias("max_sector"))


def coverage_status(products: DataFrame, cached: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Per system: available, cached and fetchable sectors; a missing sector counts
    for the first author in ``preference`` that offers it, else as unfetched."""
    per = products.groupBy("tic", "sector").agg(*[
        F.max((F.col("author") == a).cast("int")).alias(f"_{a}") for a in preference])
    j = per.join(cached.select("tic", "sector").distinct().withColumn("_have", F.lit(1)), ["tic", "sector"], "left")
    via = F.lit(None).cast("string")
    for a in reversed(preference):
        via = F.when(F.col(f"_{a}") == 1, a).otherwise(via)
    j = j.withColumn("_via", F.when(F.col("_have").isNull(), F.coalesce(via, F.lit("unfetched"))))
    counts = [F.count_if(F.col("_via") == a).alias(f"n_new_{a}") for a in preference]
    lists = [F.array_sort(F.collect_set(F.when(F.col("_via") == a, F.col("sector")))).alias(f"new_{a}") for a in preference]
    return j.groupBy("tic").agg(F.count(F.lit(1)).alias("n_available"), F.count("_have").alias("n_cached"), *counts, *lists,
                                F.count_if(F.col("_via") == "unfetched").alias("n_unfetched"))
