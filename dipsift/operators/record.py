"""Assembly of benchmark records: one row per event, the same for every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit
from dipsift.operators import gaps, pairs, views
from dipsift.operators.hosts import lookup
from dipsift.operators.incumbent import event_scalars, incumbent_block, validity_bits
from dipsift.operators.lineage import materialise

KEY = ["event_id"]
STACK_KEY = [*views.FOLD_PLACE, *KEY]


NATIVE = -1


def event_pairs(lc: DataFrame, events: DataFrame, cadence_key: str, local_source: DataFrame | None = None,
                source: str = "model_idx") -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """(local window pairs, their key, local scatter, fold stack by ``STACK_KEY``).

    ``local_source`` holds further curves, told apart by ``source`` (a non-negative
    number).  An event that names one there is cut from it, an event with NULL from
    ``lc``; so injected and native events pass in one call.  The stack of both reads
    ``lc``.  An event that names a missing curve has no window.

    All pairs of an event lie in one place, and the keys name it, so nothing that is grouped by
    these keys is shuffled.  ``events`` are read several times and should be written."""
    cols = ["tic", "sector", "time", "flux"]
    own = ["tic", "sector", *KEY, "event_time", "depth", "duration"]
    if local_source is None:
        where = views.WINDOW_PLACE
        local = views.gathered_windows(lc.select(*cols), events.select(*own))
    else:
        where = [*views.WINDOW_PLACE, "_source"]
        both = lc.select(*cols).withColumn("_source", F.lit(NATIVE).cast("bigint")).unionByName(
            local_source.select(*cols, F.col(source).cast("bigint").alias("_source")))
        named = events.select(*own, F.coalesce(F.col(source).cast("bigint"), F.lit(NATIVE)).alias("_source"))
        local = views.gathered_windows(both, named, [*views.CURVE, "_source"])
    by = [*where, *KEY]
    scatter = materialise(views.local_scatter(local, by).select(*KEY, "local_scatter"), "local-scatter")
    # The scatter travels with the arc.
    arcs = events.select("tic", *KEY, "event_time", "phase", "depth", "duration", "period").join(scatter, KEY)
    fold = views.fold_pairs(lc.select("tic", "time", "flux", "phase", F.col(cadence_key).alias("_cadence")), arcs, ["_cadence"], gathered=True)
    return local, by, scatter, views.stacked(fold, None, STACK_KEY)


def build_scalars(lc: DataFrame, events: DataFrame, hosts: DataFrame, cadence_key: str = "event_id",
                  pairs_admitted: bool = True, pair_group: tuple[str, ...] = ("tic",),
                  real_search: Column | None = None, local_source: DataFrame | None = None) -> DataFrame:
    """Scalars, gap distance, stack summary, observed partner and validity bits of
    every event whose system is known (others are dropped by the inner lookup).
    The skye flag only has a meaning where ``real_search`` holds (everywhere by default)."""
    if real_search is not None:
        events = events.withColumn("skye_flag", F.when(real_search, F.col("skye_flag")))
    host_cols = ["tic", "period", "tmag", "morph_coeff", "log10_pp_over_pbin",
                 "same_star_multi_allowed", "depth_ratio_raw"]
    ev = materialise(lookup(events, hosts.select(*host_cols), KEY).where("host_found = 1").drop("host_found"), "record-events")
    _, _, scatter, stack = event_pairs(lc, ev, cadence_key, local_source)
    recur = views.recurrence_scalars(stack, STACK_KEY).drop(*views.FOLD_PLACE)
    gap = gaps.gap_distance(lc, ev.select("tic", "sector", *KEY, "event_time"), "event_time").select(*KEY, "gap_proximity")
    partner = pairs.nearest_partner(
        ev.select(*dict.fromkeys([*pair_group, "tic", *KEY, "event_time", "duration", "depth", "period"])), list(pair_group))
    partner = partner.select(*KEY, "partner_dt", "partner_depth", "pair_duration_ratio")
    df = (ev.join(gap, KEY, "left").join(scatter, KEY, "left").join(recur, KEY, "left").join(partner, KEY, "left")
          .fillna(0.0, ["local_scatter", "rec_depth_med", "rec_depth_mad", "rec_frac_dipping"])
          .fillna(0, ["n_cycles_raw"]))
    df = pairs.observed_pair_scalars(event_scalars(df), "depth_ratio_raw")
    return validity_bits(df, pairs_admitted)


def assemble(scalars: DataFrame, comparator: DataFrame, order: str, flags: DataFrame) -> DataFrame:
    """The benchmark record: the event scalars with their incumbent block (zeros and
    validity 0 where no comparison exists) and the per-event ``flags``."""
    block = incumbent_block(scalars.select(*KEY), comparator, order, KEY[0])
    return scalars.join(block, KEY).join(flags, KEY)


def build_views(lc: DataFrame, events: DataFrame, hosts: DataFrame, cadence_key: str = "event_id",
                local_source: DataFrame | None = None) -> DataFrame:
    """Dense local [2, 201] and recurrence [2, 64] arrays per event, zeros where empty."""
    return views.dense(occupied_views(lc, events, hosts, cadence_key, local_source), VIEWS)


#: Name, bins and channels of both views.
VIEWS = {"local": (k.LOCAL_BINS, ["value", "valid"]), "recurrence": (k.RECUR_BINS, ["value", "cycles"])}


def occupied_views(lc: DataFrame, events: DataFrame, hosts: DataFrame, cadence_key: str = "event_id",
                   local_source: DataFrame | None = None) -> DataFrame:
    """Occupied bins of both views per event, as arrays of (bin, channels); :func:`views.dense` makes
    the wide arrays, best after the last join."""
    ev = materialise(lookup(events, hosts.select("tic", "period"), KEY).where("host_found = 1"), "view-events")
    local, by, _, stack = event_pairs(lc, ev, cadence_key, local_source)
    a = views.local_bins(local, by).groupBy(*by).agg(F.collect_list(F.struct("bin", *VIEWS["local"][1])).alias("local"))
    b = views.recurrence_bins(stack, STACK_KEY).groupBy(*STACK_KEY).agg(
        F.collect_list(F.struct("bin", *VIEWS["recurrence"][1])).alias("recurrence"))
    return ev.select(*KEY).join(a.select(*KEY, "local"), KEY, "left").join(b.select(*KEY, "recurrence"), KEY, "left")
