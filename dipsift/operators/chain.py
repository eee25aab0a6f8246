"""An injection campaign from plan to recovery, with failures as data and resumable ranges.

Every test keeps its row through all steps.  What cannot go on (no curve, a broken curve, no free epoch) gets a
reason instead of stopping the run.  All draws are hashes of the test's number, so that neither partitioning,
nor ranges, nor a run that was interrupted and taken up again change a result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions import physics
from dipsift.functions.expr import finite, lit, uniform
from dipsift.operators import injection, matching, sampling, search
from dipsift.operators.campaign import injection_plan
from dipsift.operators.hosts import lookup
from dipsift.operators.lineage import materialise
from dipsift.operators.pairs import covered, within_cadence
from dipsift.operators.skew import attach

CURVE = injection.CURVE
#: (free cadences, tests) -> (model_idx, inj_time); cadences: model_idx, tic, sector, time and what the source has beside.
Placement = Callable[[DataFrame, DataFrame], DataFrame]


def _own_curves(df: DataFrame) -> DataFrame:
    """Each test's copy as a curve of its own, for placements that know curves only."""
    return df.withColumn("tic", F.col("model_idx"))


@dataclass(frozen=True)
class Anywhere:
    seed: str

    def __call__(self, cadences: DataFrame, tests: DataFrame) -> DataFrame:
        return injection.uniform_epochs(_own_curves(cadences), _own_curves(tests), self.seed).select("model_idx", "inj_time")

    def among(self, times: Column) -> Column:
        """What the call takes of a test's free ``times``, an array in order."""
        return F.get(times, F.floor(uniform(self.seed, F.col("model_idx")) * F.size(times)).cast("int"))


def anywhere(seed: str) -> Placement:
    """Every free cadence of the test's curve alike."""
    return Anywhere(seed)


def like_histogram(seed: str, histogram: DataFrame, tries: int = k.EPOCH_TRIES) -> Placement:
    """Bins first, by the masses of ``histogram`` (bin, n); the cadences must carry their ``bin``."""
    def place(cadences: DataFrame, tests: DataFrame) -> DataFrame:
        rows = materialise(_own_curves(cadences).select(*CURVE, "time", "bin"), "binned-copies")
        return injection.matched_epochs(rows, histogram, _own_curves(tests), seed, tries).select("model_idx", "inj_time")
    return place


@dataclass
class Source:
    """What a campaign injects into: all cadences, those eligible for a dip, the searched events and the hosts.

    ``cadences``: tic, sector, time, flux, phase, cadence_id; ``eligible``: tic, sector, time and what the placement reads;
    ``events``: tic, sector, event_id, event_time, duration; ``hosts``: tic, period, p_crit, depth_ratio."""
    cadences: DataFrame
    eligible: DataFrame
    events: DataFrame
    hosts: DataFrame
    least: int = 5
    searched: dict = field(default_factory=dict)  # lengths, max_step, cadence, tolerance of the search


def curve_faults(cadences: DataFrame, least: int) -> DataFrame:
    """(tic, sector, reason) of every curve; the reason is null where the curve is sound."""
    good = F.count_if(finite(F.col("flux")) & finite(F.col("time")))
    return cadences.groupBy(*CURVE).agg(F.when(good < F.count(F.lit(1)), "values not finite").when(
        F.count(F.lit(1)) < least, "too few cadences").alias("reason"))


def planned(tests: DataFrame, source: Source, seed: str) -> DataFrame:
    """Tests with their curve, the coin flip of inversion, the drawn partner and the reason why one cannot go on.

    ``tests``: model_idx, tic, per_system, inj_depth, inj_duration, partner_requested."""
    curves = materialise(curve_faults(source.cadences, source.least), "curves")
    places = injection_plan(tests, curves.select(*CURVE), f"{seed}.file")
    rows = tests.drop(*CURVE).join(places, "model_idx", "left").join(curves, CURVE, "left")
    rows = rows.withColumns({"reason": F.when(F.col("sector").isNull(), "no curve").otherwise(F.col("reason")),
                             "inverted_lc": (uniform(f"{seed}.flip", F.col("model_idx")) < lit(k.INVERT_RATE)).cast("int")})
    known = lookup(rows.where("sector IS NOT NULL"), source.hosts.select("tic", "period", "p_crit", "depth_ratio"), ["model_idx"]).where(
        "host_found = 1 AND partner_requested = 1")
    known = known.withColumn("p_planet", physics.planet_period(F.col("p_crit"), f"{seed}.planet", F.col("model_idx")))
    drawn = sampling.with_partner_draws(known, f"{seed}.partner", "model_idx", "inj_duration", "depth_ratio").select(
        "model_idx", "partner_dt", "partner_ratio", "partner_duration_ratio")
    return materialise(rows.join(drawn, "model_idx", "left"), "planned")


def free_cadences(tests: DataFrame, source: Source) -> tuple[DataFrame, DataFrame]:
    """(free, blocked): each test's eligible cadences, in native curves without those near a searched event; and
    how many were taken away per test."""
    copies = attach(source.eligible, tests.select(*CURVE, "model_idx", "inverted_lc", "inj_duration"), CURVE, ["time"], "inner")
    native = tests.where("inverted_lc = 0").select(*CURVE, "model_idx", "inj_duration")
    half = (F.col("duration") + F.col("inj_duration")) / lit(2) + lit(k.CADENCE_DAYS)
    spans = attach(source.events.select(*CURVE, "event_time", "duration"), native, CURVE, ["event_time"], "inner").select(
        "model_idx", (F.col("event_time") - half).alias("_a"), (F.col("event_time") + half).alias("_z"))
    marked = materialise(covered(copies.where("inverted_lc = 0"), spans, ["model_idx"], "time", "_a", "_z"), "marked")
    blocked = marked.groupBy("model_idx").agg(F.count_if(F.col("covered") == 1).alias("n_blocked"))
    free = marked.where("covered = 0").drop("covered").unionByName(copies.where("inverted_lc = 1"))
    return free.drop("inverted_lc", "inj_duration"), blocked


#: Eligible cadences times searched events of a curve that a test compares one by one; changes the cost alone.
MEETINGS = 50_000


def free_times(tests: DataFrame, source: Source) -> DataFrame:
    """The tests with the times of :func:`free_cadences` as an array in order, ``_free``, and ``n_blocked``.  For curves whose
    eligible times fit one row; tests of a curve without any drop out."""
    times = source.eligible.where("time IS NOT NULL").groupBy(*CURVE).agg(F.array_sort(F.collect_list("time")).alias("_times"))
    seen = source.events.groupBy(*CURVE).agg(F.collect_list(F.struct("event_time", "duration")).alias("_seen"))

    def near(t: Column) -> Column:
        def covers(event: Column) -> Column:
            half = (event["duration"] + F.col("inj_duration")) / lit(2) + lit(k.CADENCE_DAYS)
            return (t > event["event_time"] - half) & (t < event["event_time"] + half)
        return F.coalesce(F.exists("_seen", covers), F.lit(False))
    free = F.when(F.col("inverted_lc") == 1, F.col("_times")).otherwise(F.filter("_times", lambda t: ~near(t)))
    return (injection.beside(tests, times.join(seen, CURVE, "left"), "model_idx", injection.COPIES).withColumn("_free", free)
            .withColumn("n_blocked", (F.size("_times") - F.size("_free")).cast("bigint")).drop("_times", "_seen"))


def placed(tests: DataFrame, source: Source, placement: Placement, whole: int = search.WHOLE, meetings: int = MEETINGS) -> tuple[DataFrame, DataFrame]:
    """(tests that found an epoch, with ``inj_time``; n_blocked by test).

    Where any free cadence will do, a test chooses beside the times of its curve, and no copies are made; long or busy curves, and
    other placements, have their free cadences as rows."""
    def by_rows(tests: DataFrame, source: Source) -> tuple[DataFrame, DataFrame]:
        free, blocked = free_cadences(tests, source)
        return materialise(tests.join(placement(free, tests), "model_idx"), "placed-tests"), blocked
    if not isinstance(placement, Anywhere):
        return by_rows(tests, source)
    sizes = source.eligible.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("_n")).join(
        source.events.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("_m")), CURVE, "left")
    long = materialise(sizes.where((F.col("_n") > whole) | (F.col("_n") * F.col("_m") > meetings)).select(*CURVE), "long-curves")  # few, as a row stands for many
    split = not long.isEmpty()
    short = Source(source.cadences, source.eligible.join(F.broadcast(long), CURVE, "left_anti"), source.events.join(F.broadcast(long), CURVE, "left_anti"),
                   source.hosts) if split else source
    near = free_times(tests, short)
    chosen = materialise(near.withColumn("inj_time", placement.among(F.col("_free"))).drop("_free"), "placed-tests")
    rows, blocked = chosen.where("inj_time IS NOT NULL").drop("n_blocked"), chosen.select("model_idx", "n_blocked")
    if split:
        others, more = by_rows(tests.join(F.broadcast(long), CURVE, "left_semi"), source)
        rows, blocked = rows.unionByName(others), blocked.unionByName(more)
    return rows, blocked


def searched_copies(cadences: DataFrame, tests: DataFrame, transits: DataFrame, whole: int = search.WHOLE, **searched) -> DataFrame:
    """What a search finds in each test's copy of its curve with its ``transits``: the rows of :func:`search.search`.

    A curve of up to ``whole`` cadences goes to its tests in one piece, and its copies are searched where they are made, so
    neither copies nor peaks are shuffled or written.  Longer curves are cut by time."""
    sizes = cadences.where(F.col("time").isNotNull()).groupBy(*CURVE).agg(F.count(F.lit(1)).alias("_n"))
    long = materialise(sizes.where(F.col("_n") > whole).select(*CURVE), "long-curves")  # few: a row stands for many cadences
    if long.isEmpty():
        return search.search_whole(injection.whole_copies(cadences, tests, transits), ["model_idx"], **searched)
    found = search.search_whole(injection.whole_copies(cadences.join(F.broadcast(long), CURVE, "left_anti"), tests, transits), ["model_idx"], **searched)
    copies = injection.injected_curves(cadences.join(F.broadcast(long), CURVE, "left_semi"), tests.join(F.broadcast(long), CURVE, "left_semi"), transits, "cadence_id")
    return found.unionByName(search.search(copies.select("model_idx", "time", "flux"), ["model_idx"], **searched))


def campaign(tests: DataFrame, source: Source, placement: Placement, seed: str = "campaign") -> DataFrame:
    """One row for each test: where and what was injected, ``state`` (done or failed) with its ``reason``, and what was found.

    Plan, inversion and partner draws; then :func:`carried_out`."""
    return carried_out(planned(tests, source, seed), source, placement)


def carried_out(plan: DataFrame, source: Source, placement: Placement) -> DataFrame:
    """The rows of :func:`campaign` for tests that are :func:`planned`: blocked cadences; placement; partners only
    where there are data; injected flux; search; recovery labels."""
    going = plan.where("reason IS NULL")
    rows, blocked = placed(going, source, placement)
    rows = rows.withColumn("partner_time", F.col("inj_time") + F.col("partner_dt"))
    asked = rows.where("partner_time IS NOT NULL").select(*CURVE, "model_idx", F.col("partner_time").alias("time"))
    seen = within_cadence(source.cadences.select(*CURVE, "time"), asked, CURVE, "time").select("model_idx", F.lit(1).alias("_on"))
    rows = rows.join(seen, "model_idx", "left").withColumn("partner_time", F.when(F.col("_on") == 1, F.col("partner_time"))).drop("_on")
    rows = materialise(rows, "injected-tests")
    found = searched_copies(source.cadences, rows, injection.partner_transits(rows), **source.searched)
    labelled = matching.recovery_labels(found, rows, ["model_idx"], ["group_id"])
    judged = matching.recovery_by_test(rows, labelled, ["model_idx"]).select(
        "model_idx", "inj_time", "partner_time", "recovered", "recovered_partner", "recovered_pair", "n_events_flagged")
    out = plan.join(judged, "model_idx", "left").join(blocked, "model_idx", "left")
    reason = F.when(F.col("reason").isNull() & F.col("inj_time").isNull(), "no free epoch").otherwise(F.col("reason"))
    partner = F.when(F.col("partner_requested") != 1, "none").when(F.col("partner_dt").isNull(), "no window").when(
        F.col("partner_time").isNull(), "off data").otherwise("injected")
    return out.select("model_idx", *CURVE, "inverted_lc", F.when(reason.isNull(), "done").otherwise("failed").alias("state"), reason.alias("reason"),
                      F.coalesce("n_blocked", F.lit(0)).alias("n_blocked"), "inj_time", partner.alias("partner_state"), "partner_time", "partner_ratio",
                      "partner_duration_ratio", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("recovered", "recovered_partner", "recovered_pair", "n_events_flagged")])


# --- resumable runs ------------------------------------------------------------


def finished(spark: SparkSession, folder: str) -> dict[tuple[int, int], str]:
    """Ranges that the ledger of ``folder`` has, and where their rows are."""
    try:
        ledger = spark.read.parquet(f"{folder}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {(r["lo"], r["hi"]): r["path"] for r in ledger.collect()}  # one row for each range of a run


def run_ranges(tests: DataFrame, bounds: Sequence[tuple[int, int]], folder: str, run: Callable[[DataFrame], DataFrame],
               key: str = "model_idx", together: int = 1) -> DataFrame:
    """All rows of ``run`` over contiguous ranges [lo, hi) of ``key``; ranges that the ledger has are not run again.

    A range is entered once its rows are written, under a name of its own: what an interrupted run left is never read.
    ``together`` ranges run side by side, as their many short jobs leave cores idle; the ledger is written by one hand."""
    spark = tests.sparkSession

    stop = Event()

    def written(bound: tuple[int, int]) -> tuple[int, int, str] | None:
        if stop.is_set():
            return None
        lo, hi = bound
        path = f"{folder}/rows-{lo}-{hi}-{uuid.uuid4().hex}"
        run(tests.where((F.col(key) >= lo) & (F.col(key) < hi))).write.parquet(path)
        return lo, hi, path

    done = finished(spark, folder)
    missing = [b for b in dict.fromkeys(bounds) if b not in done]
    with ThreadPool(max(1, together)) as pool:
        lost = None
        for task in [pool.apply_async(written, (b,)) for b in missing]:
            try:
                entry = task.get()
            except Exception as e:  # no further range begins, those that run are still entered
                lost = lost or e
                stop.set()
                continue
            if entry is None:
                continue
            spark.createDataFrame([entry], "lo long, hi long, path string").write.mode("append").parquet(f"{folder}/ledger")
    if lost is not None:
        raise lost
    known = finished(spark, folder)
    return spark.read.parquet(*[known[b] for b in bounds])
