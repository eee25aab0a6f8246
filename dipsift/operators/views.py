"""Event windows and fold-and-stack feature views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from dipsift.functions import constants as k
from dipsift.functions.expr import bin_of, depth_floor, lit, local_half, signed_phase
from dipsift.operators.skew import arc_join, centred_join, range_join, ring_join

CURVE = ["tic", "sector"]
#: Where all pairs of an event lie, see :func:`gathered_windows` and :func:`fold_pairs`.
WINDOW_PLACE = [*CURVE, "_shard"]
FOLD_PLACE = ["tic", "_slot", "_way"]


def cycle_from_phase(time: Column) -> Column:
    """Orbit number counted from the epoch the event's own phase implies, so the
    event sits in cycle floor(phase) = 0."""
    start = F.col("event_time") - F.col("phase") * F.col("period")
    return F.floor((time - start) / F.col("period"))


def centred_cycle(time: Column) -> Column:
    return F.floor((time - F.col("event_time")) / F.col("period") + lit(0.5))


def event_windows(lc: DataFrame, events: DataFrame, spread: Sequence[str],
                  half: Column | None = None, keys: Sequence[str] = CURVE) -> DataFrame:
    """Every cadence within the local half width of an event of the same curve; ``keys``
    name the curve."""
    half = local_half(F.col("duration")) if half is None else half
    ev = (events.withColumn("_half", half)
          .withColumn("_wlo", F.col("event_time") - F.col("_half") - lit(1e-6))
          .withColumn("_whi", F.col("event_time") + F.col("_half") + lit(1e-6)))
    # The bucket bounds carry slack; the exact rule is the distance itself.
    return (range_join(lc, ev, keys, "time", "_wlo", "_whi", 1.0, spread)
            .where(F.abs(F.col("time") - F.col("event_time")) <= F.col("_half"))
            .drop("_wlo", "_whi"))


def gathered_windows(lc: DataFrame, events: DataFrame, keys: Sequence[str] = CURVE) -> DataFrame:
    """As :func:`event_windows`, with all pairs of an event in one (keys, ``_shard``), so that
    grouping them by event needs no shuffle."""
    return centred_join(lc, events.withColumn("_half", local_half(F.col("duration"))), keys, "time", "event_time", "_half")


def snippets(lc: DataFrame, events: DataFrame, event_key: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Event windows as one time-ordered array of samples per event (bounded by
    the window, not by the curve)."""
    pairs = event_windows(lc, events, spread)
    samples = F.array_sort(F.collect_list(F.struct("time", "flux", "flux_err")))
    return pairs.groupBy(*event_key).agg(samples.alias("samples"),
                                         F.count(F.lit(1)).alias("n_samples"),
                                         F.first("_half").alias("halfwidth"))


def local_scatter(pairs: DataFrame, event_key: Sequence[str]) -> DataFrame:
    """Robust scatter of the cadences more than one duration from the event; with
    five or fewer of those the population deviation of the whole window; floored."""
    rel = F.abs(F.col("time") - F.col("event_time"))
    oot = F.when(rel > F.col("duration"), F.col("flux"))
    # A group is one event window, bounded in time, so one shuffle serves both medians.
    event = Window.partitionBy(*event_key)
    stats = (pairs.withColumn("_oot", oot).withColumn("_med", F.median("_oot").over(event))
             .groupBy(*event_key)
             .agg(F.count("_oot").alias("_n"), F.stddev_pop("flux").alias("_std"),
                  (lit(k.MAD_TO_SIGMA) * F.median(F.abs(F.col("_oot") - F.col("_med")))).alias("_mad")))
    raw = F.when(F.col("_n") > k.SCATTER_MIN_POINTS, F.col("_mad")).otherwise(F.col("_std"))
    return stats.select(*event_key, F.when(raw > 0, raw).otherwise(lit(k.SCATTER_FLOOR)).alias("local_scatter"))


def local_bins(pairs: DataFrame, event_key: Sequence[str]) -> DataFrame:
    """Occupied bins of the local view: (event, bin, value, valid)."""
    b = bin_of(F.col("time") - F.col("event_time"), -F.col("_half"), F.col("_half"), k.LOCAL_BINS)
    return (pairs.groupBy(*event_key, b.alias("bin"))
            .agg((F.median("flux") - lit(1)).alias("value"))
            .withColumn("valid", lit(1)))


def dense(df: DataFrame, shapes: dict[str, tuple[int, Sequence[str]]]) -> DataFrame:
    """Columns of occupied bins, arrays of (bin, channels), -> ``ARRAY<ARRAY<FLOAT>>`` of fixed width,
    zeros elsewhere and where there is no array; other columns pass.  ``shapes``: bins and channels by column.

    Batches are filled as a whole: looking up each bin of each row in an expression costs far more."""
    wide = ArrayType(ArrayType(FloatType()))
    schema = StructType([StructField(f.name, wide) if f.name in shapes else f for f in df.schema.fields])
    shapes = {name: (n, list(channels)) for name, (n, channels) in shapes.items()}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def filled(column, n, channels):
            at = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            entries = column.flatten()
            cells = dict(zip([f.name for f in entries.type], entries.flatten()))
            out = np.zeros((len(column), len(channels), n), np.float32)
            places = cells["bin"].to_numpy(zero_copy_only=False).astype(np.int64)
            for i, c in enumerate(channels):
                out[at, i, places] = pc.fill_null(cells[c].cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            rows = pa.ListArray.from_arrays(np.arange(0, out.size + 1, n, dtype=np.int32), pa.array(out.ravel()))
            return pa.ListArray.from_arrays(np.arange(0, len(rows) + 1, len(channels), dtype=np.int32), rows)

        for batch in batches:
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [filled(c, *shapes[name]) if name in shapes else c for name, c in zip(names, batch.columns)], names=names)

    return df.mapInArrow(run, schema)


def fold_pairs(lc: DataFrame, events: DataFrame, spread: Sequence[str], capped: DataFrame | None = None,
               event_key: Sequence[str] = ("event_id",), gathered: bool = False) -> DataFrame:
    """Cadences of any sector of the event's system at the event's phase: inside
    the stacking window or the continuum sideband, the event's own cycle left out.

    ``events``: tic, event key, event_time, phase, duration, period (> 0).
    ``lc``: tic, time, flux, phase.  Adds dphi, cycle, in_window, in_sideband.

    ``capped``: event key, ``cycles`` (an array as long as the event's budget).  An event
    then sees only its local window, its own cycle and these; the array travels with the
    arc, so cadences of other cycles never leave the join.  An event without a row has no
    other cycles.

    With ``gathered`` all pairs of an event lie in one ``FOLD_PLACE``, so that grouping them by event
    needs no shuffle."""
    reach = F.greatest(lit(k.RECUR_WINDOW_DURATIONS), lit(k.SIDEBAND_OUTER_DURATIONS)) * F.col("duration") / F.col("period")
    arcs = (events.where((F.col("period") > 0) & (F.col("duration") > 0))
            .withColumn("_half", reach + lit(1e-9)))
    if capped is not None:
        arcs = arcs.join(capped.select(*event_key, F.col("cycles").alias("_cycles")), list(event_key), "left")
    pts = lc.select("tic", "time", "flux", F.col("phase").alias("_ph"), *[c for c in spread if c not in ("time", "tic")])
    df = (arc_join if gathered else ring_join)(pts, arcs, ["tic"], "_ph", "phase", "_half", spread)
    if capped is not None:
        orbit = centred_cycle(F.col("time"))
        df = df.where((F.abs(F.col("time") - F.col("event_time")) <= local_half(F.col("duration"))) | (orbit == 0)
                      | F.coalesce(F.array_contains("_cycles", orbit), F.lit(False))).drop("_cycles")
    df = df.withColumn("dphi", signed_phase(F.col("_ph"), F.col("phase")))
    offset = F.abs(F.col("dphi")) * F.col("period")
    return (df.withColumn("cycle", cycle_from_phase(F.col("time")))
            .withColumn("in_window", F.abs(F.col("dphi")) <= lit(k.RECUR_WINDOW_DURATIONS) * F.col("duration") / F.col("period"))
            .withColumn("in_sideband", (offset > lit(k.RECUR_WINDOW_DURATIONS) * F.col("duration"))
                        & (offset <= lit(k.SIDEBAND_OUTER_DURATIONS) * F.col("duration")))
            .where((F.col("in_window") | F.col("in_sideband")) & (F.col("cycle") != F.floor("phase")))
            .drop("_ph", "_half"))


def stacked(pairs: DataFrame, scatter: DataFrame | None, event_key: Sequence[str]) -> DataFrame:
    """In-window cadences divided by their cycle's continuum, with the event's
    normalising depth ``denom``.  Without ``scatter`` the pairs carry ``local_scatter``.

    Continuum of an (event, cycle): sideband median with enough sideband points,
    else the in-window median; level 0 drops the cycle.  The group spans a few
    durations of one orbit, so a window over it stays small, and the later
    per-cycle aggregation reuses its partitioning."""
    cycle = Window.partitionBy(*event_key, "cycle")
    side, win = F.when(F.col("in_sideband"), F.col("flux")), F.when(F.col("in_window"), F.col("flux"))
    level = F.when(F.col("_ns") >= k.SIDEBAND_MIN_POINTS, F.col("_ms")).otherwise(F.col("_mw"))
    kept = (pairs.withColumn("_side", side).withColumn("_win", win)
            .withColumns({"_ns": F.count("_side").over(cycle), "_ms": F.median("_side").over(cycle),
                          "_mw": F.median("_win").over(cycle)})
            .where("in_window").withColumn("continuum", level).where("continuum <> 0")
            .drop("_side", "_win", "_ns", "_ms", "_mw"))
    return ((kept if scatter is None else kept.join(scatter, list(event_key)))
            .withColumn("level", F.col("flux") / F.col("continuum"))
            .withColumn("denom", depth_floor(F.col("depth"), F.col("local_scatter"))))


def recurrence_bins(stack: DataFrame, event_key: Sequence[str]) -> DataFrame:
    half = lit(k.RECUR_WINDOW_DURATIONS) * F.col("duration") / F.col("period")
    b = bin_of(F.col("dphi"), -half, half, k.RECUR_BINS)
    # Distinct cycles per bin: merge (event, bin, cycle) first, then count.
    return (stack.groupBy(*event_key, b.alias("bin"))
            .agg((F.median(F.col("level") - lit(1)) / F.first("denom")).alias("value"),
                 F.log1p(F.least(F.countDistinct("cycle"), F.lit(k.CYCLE_CAP)).cast("double")).alias("cycles")))


def recurrence_scalars(stack: DataFrame, event_key: Sequence[str]) -> DataFrame:
    """Deepest cadence per cycle, then median, robust spread, dipping share and
    the number of contributing cycles."""
    per = (stack.groupBy(*event_key, "cycle")
           .agg(F.max((lit(1) - F.col("level")) / F.col("denom")).alias("d"),
                F.first(lit(3) * F.col("local_scatter") / F.col("denom")).alias("_thr")))
    return (per.withColumn("_med", F.median("d").over(Window.partitionBy(*event_key)))
            .groupBy(*event_key)
            .agg(F.first("_med").alias("rec_depth_med"),
                 F.avg((F.col("d") > F.col("_thr")).cast("double")).alias("rec_frac_dipping"),
                 F.count(F.lit(1)).alias("n_cycles_raw"),
                 (lit(k.MAD_TO_SIGMA) * F.median(F.abs(F.col("d") - F.col("_med")))).alias("rec_depth_mad")))
