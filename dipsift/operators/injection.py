"""Placement of synthetic transits and the flux they add."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from dipsift.functions import constants as k
from dipsift.functions.expr import lit, uniform
from dipsift.operators.clean import inverted
from dipsift.operators.lineage import materialise
from dipsift.operators.ordered import running_total
from dipsift.operators.skew import attach

CURVE = ["tic", "sector"]


def uniform_epochs(cadences: DataFrame, tests: DataFrame, seed: str, test_key: str = "model_idx") -> DataFrame:
    """A cadence of the test's curve drawn uniformly; tests whose curve has no
    eligible cadence drop out."""
    numbered = running_total(cadences.select(*CURVE, "time"), CURVE, "time", F.lit(1), "_i")
    sizes = cadences.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("_n"))
    want = (attach(tests.select(*CURVE, test_key), sizes, CURVE, [test_key], "inner")
            .withColumn("_i", F.floor(uniform(seed, F.col(test_key)) * F.col("_n")) + 1))
    return want.join(numbered, [*CURVE, "_i"]).select(test_key, *CURVE, F.col("time").alias("inj_time"))


#: Tests of one curve that share a copy of its bins.
TOGETHER = 65_536
OUTCOMES = ["bin_hit", "redraw", "nearest", "uniform"]


def _place(masses: dict[int, int], carried: Sequence[str]):
    """Arrow batches of tests (``carried``, _bins, _tries, _fall, _pick) -> chosen bin, number of the cadence in it, outcome."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = np.array(sorted(masses), np.int64)
        mass_of = np.array([masses[b] for b in sorted(masses)], np.int64)
        shares = np.cumsum(mass_of)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("_bins")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            entries = lists.flatten()
            bins, sizes = (c.to_numpy(zero_copy_only=False) for c in entries.flatten())
            row, ends = np.repeat(np.arange(n), lengths), np.cumsum(lengths)
            mass = np.zeros(len(bins), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, bins), len(known) - 1)
                mass = np.where(known[at] == bins, mass_of[at], 0)
            massive = np.bincount(row, weights=mass, minlength=n) > 0
            # The populated bin whose share of the curve's weight holds the fall-back draw.
            weight = np.cumsum(np.where(massive[row], mass, sizes))
            upto = weight[ends - 1]
            below = np.concatenate([[0], upto[:-1]])
            fall = np.floor(batch.column("_fall").to_numpy() * (upto - below)).astype(np.int64)
            chosen = np.searchsorted(weight, below + fall, side="right")
            outcome = np.where(massive, 2, 3)
            if len(known):
                tries = batch.column("_tries").flatten().to_numpy().reshape(n, -1)
                drawn = known[np.searchsorted(shares, np.floor(tries * shares[-1]).astype(np.int64), side="right")]
                every = np.unique(np.concatenate([known, bins]))
                has = row * len(every) + np.searchsorted(every, bins)
                asked = np.arange(n)[:, None] * len(every) + np.searchsorted(every, drawn)
                at = np.minimum(np.searchsorted(has, asked), len(has) - 1)
                hit = has[at] == asked
                first, found = hit.argmax(axis=1), hit.any(axis=1)
                chosen = np.where(found, at[np.arange(n), first], chosen)
                outcome = np.where(found, np.where(first == 0, 0, 1), outcome)
            number = np.floor(batch.column("_pick").to_numpy() * sizes[chosen]).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(outcome.astype(np.int32)), pa.array(bins[chosen]), pa.array(number)],
                names=[*carried, "_outcome", "bin", "_i"])
    return run


def beside(tests: DataFrame, curves: DataFrame, test_key: str, together: int) -> DataFrame:
    """Each test with what ``curves`` has of its curve, in one row for each curve.  A curve with more than ``together`` tests goes several ways."""
    busy = materialise(tests.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > together).select(
        *CURVE, F.ceil(F.col("_c") / F.lit(together)).cast("bigint").alias("_ways")), "busy-curves")  # few: a row stands for many tests
    ways, none = F.coalesce("_ways", F.lit(1)), F.lit(0).cast("bigint")
    spread = (tests.where(F.col(test_key).isNotNull()).join(F.broadcast(busy), CURVE, "left")
              .withColumn("_way", F.pmod(F.xxhash64(test_key), ways)).drop("_ways"))
    copied = curves.join(F.broadcast(busy), CURVE, "left").withColumn("_way", F.explode(F.sequence(none, ways - 1))).drop("_ways")
    # Dealt by the join's keys, so that all cores have a share of few bytes even where the curves are broadcast.
    spark = tests.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spread.repartition(tasks, *CURVE, "_way").join(copied, [*CURVE, "_way"]).drop("_way")


def matched_epochs(cadences: DataFrame, histogram: DataFrame, tests: DataFrame, seed: str,
                   tries: int = k.EPOCH_TRIES, test_key: str = "model_idx", together: int = TOGETHER) -> DataFrame:
    """Bin-first importance sampling of injection epochs.

    A bin is drawn by its histogram mass, up to ``tries`` times until the test's
    curve has a cadence there; then a populated bin weighted by its mass; then any
    cadence.  ``cadences``: tic, sector, time, bin; ``histogram``: bin, n.  A test whose
    curve has no cadence drops out; an empty histogram leaves only the last way.

    A test meets the bins of its curve in one join and draws there, so tries are never
    shuffled.  A curve with more than ``together`` tests goes several ways.  Cadences are
    numbered per (curve, bin) by sharded counting."""
    own = [*CURVE, test_key]
    sizes = cadences.groupBy(*CURVE, F.col("bin").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # One entry per bin of a curve, in the order of the bins.
    curves = sizes.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("_bins"))
    masses = {r["bin"]: r["n"] for r in histogram.where("n > 0").groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # one row per bin

    def u(name: str) -> Column:
        return uniform(f"{seed}.{name}", F.col(test_key))
    asked = beside(tests.select(*own), curves, test_key, together).select(
        *own, "_bins", F.array(*[u(f"try{a}") for a in range(tries)]).alias("_tries"), u("fall").alias("_fall"), u("pick").alias("_pick"))
    schema = StructType([*asked.select(*own).schema.fields, StructField("_outcome", IntegerType()), StructField("bin", LongType()), StructField("_i", LongType())])
    t = asked.mapInArrow(_place(masses, own), schema).withColumn("outcome", F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("_outcome") + 1))
    numbered = running_total(cadences.select(*CURVE, "bin", "time"), [*CURVE, "bin"], "time", F.lit(1), "_i")
    return t.join(numbered, [*CURVE, "bin", "_i"]).select(test_key, *CURVE, "outcome", "bin", F.col("time").alias("inj_time"))


def transit_delta(time: Column, centre: Column, duration: Column, depth: Column) -> Column:
    """Flux change of a smooth dip: zero outside half a duration."""
    x = (time - centre) / (duration / lit(2))
    return F.when(F.abs(x) <= lit(1), -depth * (lit(1) - lit(k.INJECTION_CURVATURE) * x * x)).otherwise(lit(0))


def _carried(tests: DataFrame, transits: DataFrame, test_key: str) -> DataFrame:
    """Tests with the few transits of each as an array."""
    dips = (transits.where(F.col("transit_duration") >= lit(-2e-9))
            .groupBy(*CURVE, test_key).agg(F.collect_list(F.struct("centre", "transit_duration", "transit_depth")).alias("_dips")))
    return tests.select(*CURVE, test_key, "inverted_lc").join(dips, [*CURVE, test_key], "left")


def _injected_flux() -> Column:
    """Flux of a cadence after inversion, with the deltas of ``_dips``."""
    def delta(dip):
        # Only what lies in the transit is worked out, so that a duration of 0 far off divides nothing.
        near = F.abs(F.col("time") - dip["centre"]) <= dip["transit_duration"] / lit(2) + lit(1e-9)
        return F.when(near, transit_delta(F.col("time"), dip["centre"], dip["transit_duration"], dip["transit_depth"])).otherwise(lit(0))
    total = F.aggregate("_dips", lit(0).cast("double"), lambda so_far, dip: so_far + delta(dip))
    return inverted(F.col("flux"), F.col("inverted_lc")) + F.coalesce(total, lit(0))


def injected_curves(lc: DataFrame, tests: DataFrame, transits: DataFrame, cadence_key: str,
                    test_key: str = "model_idx") -> DataFrame:
    """Each test's copy of its curve: coin-flip inversion first, then the summed
    deltas of its transits.

    A test carries its few transits into the one join that makes the copies, so copies
    are not shuffled a second time to meet their deltas.  ``tests``: tic, sector,
    test_key, inverted_lc; ``transits``: tic, sector, test_key, centre,
    transit_duration, transit_depth."""
    # Every test owns a copy of its curve; a busy curve is spread over salts.
    return (attach(lc.select(*CURVE, "time", "flux", "phase", cadence_key), _carried(tests, transits, test_key), CURVE, [cadence_key], "inner")
            .withColumn("flux", _injected_flux()).drop("_dips"))


#: Tests of one curve that share a copy of its cadences.
COPIES = 1024


def whole_copies(lc: DataFrame, tests: DataFrame, transits: DataFrame, test_key: str = "model_idx", together: int = COPIES) -> DataFrame:
    """As :func:`injected_curves`, but a curve's cadences travel as one array, and each copy is made where its test meets it: the
    rows of a test lie together, in the order of time.

    Gives test_key, time, flux, ``_t`` (microdays), ``_n`` (cadences of the curve).  For curves whose cadences fit one row."""
    micros = F.round(F.col("time") * lit(1_000_000)).cast("bigint").alias("_t")
    curves = lc.where(F.col("time").isNotNull()).groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("time", "flux", micros))).alias("_cadences"))
    met = beside(_carried(tests, transits, test_key), curves, test_key, together)
    return (met.select(test_key, "inverted_lc", "_dips", F.size("_cadences").alias("_n"), F.explode("_cadences").alias("_c"))
            .select(test_key, "inverted_lc", "_dips", "_n", "_c.*").select(test_key, "time", _injected_flux().alias("flux"), "_t", "_n"))


def partner_transits(tests: DataFrame, keys: Sequence[str] = (*CURVE, "model_idx")) -> DataFrame:
    """Lead and partner transits of every test as rows; the partner has its own
    depth and duration."""
    lead = F.struct(F.col("inj_time").alias("centre"), F.col("inj_duration").alias("transit_duration"),
                    F.col("inj_depth").alias("transit_depth"))
    partner = F.when(F.col("partner_time").isNotNull(), F.struct(
        F.col("partner_time").alias("centre"), (F.col("inj_duration") * F.col("partner_duration_ratio")).alias("transit_duration"),
        (F.col("inj_depth") * F.col("partner_ratio")).alias("transit_depth")))
    both = F.filter(F.array(lead, partner), lambda t: t.isNotNull())
    return tests.select(*keys, F.explode(both).alias("_t")).select(*keys, "_t.*")
