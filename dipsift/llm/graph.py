"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipsift.operators.lineage import materialise


def _digest(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return got["n"], got["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links(u, v)``; a component is named by
    its smallest node.  Each step writes its links and their minima, so a node
    with very many links is an evenly split join, never one group in a task."""
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialise(both.where("v > u").join(low, "u").where("v <> m")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v")))
                            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
