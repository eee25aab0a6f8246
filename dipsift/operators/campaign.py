"""Injection campaigns: plans, placement, injected flux, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit, uniform
from dipsift.operators.lineage import materialise
from dipsift.operators.rank import cumulative, scalar
from dipsift.operators.skew import attach


def acceptance(tests: DataFrame, labelled: DataFrame) -> DataFrame:
    """Campaign rates on one row, the mix verdict (a breach counts only beyond two
    standard errors) and partner events without a recovered lead."""
    leads = labelled.where("pair_role = 'lead'").select("model_idx").distinct()
    orphans = labelled.where("pair_role = 'partner'").join(leads, "model_idx", "left_anti")
    off = F.abs(F.avg("inverted_lc") - lit(k.INVERT_RATE))
    se = F.sqrt(lit(k.INVERT_RATE * (1 - k.INVERT_RATE)) / F.count(F.lit(1)))
    return tests.agg(
        F.count(F.lit(1)).alias("n_tests"), F.avg("inverted_lc").alias("inversion_rate"),
        F.avg("recovered").alias("recovery_rate"), F.avg("partner_requested").alias("pair_requested_rate"),
        F.avg(F.col("recovered") * F.col("recovered_partner")).alias("pair_recovered_rate"),
        F.count_if((F.col("partner_requested") == 1) & (F.col("recovered") == 0)
                   & (F.col("recovered_partner") == 1)).alias("partner_only"),
        ((off > lit(k.GATE_MIX)) & (off > lit(2) * se)).cast("int").alias("mix_problem")) \
        .withColumn("orphans", orphans.select(F.count(F.lit(1))).scalar())


def injection_plan(tests: DataFrame, files: DataFrame, seed: str = "file") -> DataFrame:
    """Assigns each test a curve: round robin over the files of its own system, or
    a hash draw over all files.  ``tests``: model_idx, tic, per_system (boolean).

    The global file index comes from counts per system, not from one sorted task."""
    own = Window.partitionBy("tic").orderBy("sector")
    slots = files.withColumn("slot", F.row_number().over(own) - 1)
    sizes = files.groupBy("tic").agg(F.count(F.lit(1)).alias("n_files"))
    base = cumulative(sizes, [], "tic", {"n": F.col("n_files")}).select(
        "tic", F.col("n").alias("n_files"), F.col("n_below").alias("_base"), F.col("n_total").alias("_all"))
    base = materialise(base, "files-per-system")
    slots = slots.join(base, "tic").withColumn("slot_all", F.col("_base") + F.col("slot"))
    robin = (attach(tests.where("per_system").select("model_idx", "tic"), base.select("tic", "n_files"), ["tic"], ["model_idx"], "inner")
             .withColumn("slot", F.pmod("model_idx", "n_files")))
    robin = robin.drop("n_files").join(slots.select("tic", "slot", "sector"), ["tic", "slot"]) \
        .select("model_idx", "tic", "sector")
    total = scalar(base, F.max("_all"))
    drawn = (tests.where("not per_system").select("model_idx", F.floor(uniform(seed, F.col("model_idx")) * total).alias("slot_all"))
             .join(slots.select("slot_all", "tic", "sector"), "slot_all").select("model_idx", "tic", "sector"))
    return robin.unionByName(drawn)
