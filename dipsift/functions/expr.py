"""Column expressions shared by the operators: circular phase arithmetic,
keyed hash uniforms, bin indices, binomial intervals.  Pure ``Column -> Column``
so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from dipsift.functions import constants as k


def lit(x: float) -> Column:
    return F.lit(float(x))


def frac(x: Column) -> Column:
    """Fractional part in [0, 1), also for negative input."""
    return x - F.floor(x)


def fold(time: Column, epoch: Column, period: Column) -> Column:
    return frac((time - epoch) / period)


def signed_phase(phase: Column, centre: Column) -> Column:
    """Phase distance wrapped to [-0.5, 0.5)."""
    return frac(phase - centre + lit(0.5)) - lit(0.5)


def circular_distance(phase: Column, centre: Column) -> Column:
    return F.abs(signed_phase(phase, centre))


def in_eclipse(phase: Column, *eclipses: tuple[Column, Column]) -> Column:
    """True inside any eclipse ``(centre, full width)``; unknown eclipses never match."""
    hit = F.lit(False)
    for centre, width in eclipses:
        hit = hit | F.coalesce(
            circular_distance(phase, centre) <= width / lit(2), F.lit(False))
    return hit


def outside_widened(phase: Column, *eclipses: tuple[Column, Column]) -> Column:
    """True away from every eclipse widened for a noise measurement."""
    keep = F.lit(True)
    for centre, width in eclipses:
        w = F.when(width > 0, width).otherwise(lit(k.NOISE_DEFAULT_WIDTH))
        keep = keep & F.coalesce(
            circular_distance(phase, centre) > lit(k.NOISE_MASK_WIDTHS) * w, F.lit(True))
    return keep


def eclipse_edge_distance(phase: Column, *eclipses: tuple[Column, Column]) -> Column:
    """Phase distance to the nearest eclipse edge, floored at 0; NULL when no
    eclipse is usable (callers that want 0 there coalesce it)."""
    d = [F.greatest(lit(0), circular_distance(phase, c) - w / lit(2)) for c, w in eclipses]
    d = [F.when(c.isNotNull() & w.isNotNull(), x) for (c, w), x in zip(eclipses, d)]
    return F.least(*d) if len(d) > 1 else d[0]


def uniform(seed: str, *key: Column) -> Column:
    """Deterministic uniform in [0, 1): 52 bits of md5 over integer/string keys."""
    text = F.concat_ws("|", *[c.cast("string") for c in key], F.lit(seed))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits / lit(2.0 ** 52)


def normal(seed: str, *key: Column) -> Column:
    """Standard normal by Box-Muller on two keyed uniforms."""
    u1 = lit(1) - uniform(seed + ".r", *key)
    u2 = uniform(seed + ".a", *key)
    return F.sqrt(lit(-2) * F.log(u1)) * F.cos(lit(2 * math.pi) * u2)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, lit(lo)), lit(hi))


def bin_of(x: Column, lo, hi, n: int) -> Column:
    """Left-closed equal-width bin clipped into 0..n-1 (top edge in the last bin)."""
    lo = lo if isinstance(lo, Column) else lit(lo)
    hi = hi if isinstance(hi, Column) else lit(hi)
    width = hi - lo
    raw = F.when(width > 0, F.floor((x - lo) / width * lit(n))).otherwise(F.lit(0))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1)).cast("int")


def bin_of_edges(x: Column, edges: list[float]) -> Column:
    """Left-closed bin for explicit edges, clipped into range."""
    idx = F.lit(0)
    for i, e in enumerate(edges[1:-1], start=1):
        idx = F.when(x >= lit(e), F.lit(i)).otherwise(idx)
    return idx


def wilson(successes: Column, trials: Column, z: float, clipped: bool = False):
    """(low, high) of the Wilson interval, NULL when there are no trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p = successes / n
    zz = z * z
    denom = lit(1) + lit(zz) / n
    centre = (p + lit(zz) / (lit(2) * n)) / denom
    half = lit(z) * F.sqrt(p * (lit(1) - p) / n + lit(zz) / (lit(4) * n * n)) / denom
    lo, hi = centre - half, centre + half
    if clipped:
        lo = F.when(lo.isNotNull(), F.greatest(lit(0), lo))
        hi = F.when(hi.isNotNull(), F.least(lit(1), hi))
    return lo, hi


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < lit(float("inf")))


def null_if_nan(x: Column) -> Column:
    return F.when(finite(x), x)


def local_half(duration: Column) -> Column:
    return F.greatest(lit(k.LOCAL_HALF_DURATIONS) * duration, lit(k.LOCAL_HALF_MIN_DAYS))


def depth_floor(depth: Column, scatter: Column) -> Column:
    return F.greatest(depth, lit(3) * scatter)


def pair_window(period: Column, duration: Column) -> tuple[Column, Column]:
    """Spacing bounds inside which two events may be one conjunction."""
    return (F.greatest(lit(k.PAIR_MIN_DAYS), duration),
            lit(k.PAIR_MAX_PERIODS) * period)


def pair_depth_log_ratio(observed: Column, expected: Column) -> Column:
    return F.when(observed.isNotNull() & (expected > 0),
                  F.log10(F.greatest(observed, lit(1e-6)) / expected))


def operating_point(point: str, *, snr="snr", duration="duration",
                    n_detrend="n_detrend_detections", skye="skye_flag",
                    best_fit="best_fit") -> Column:
    """Queue admission.  Point A: signal, duration, detrending robustness and
    systematics flag (undefined passes).  Point B: also a transit-like best fit."""
    m = ((F.col(snr) >= lit(k.MIN_SNR)) & (F.col(duration) <= lit(k.MAX_DURATION_DAYS))
         & (F.col(n_detrend) > k.DETREND_ROBUST_ABOVE)
         & (F.coalesce(F.col(skye), F.lit(0)) == 0))
    if point == "A":
        return m
    if point == "B":
        return m & F.coalesce(F.col(best_fit).isin("T", "AT"), F.lit(False))
    raise ValueError(f"unknown operating point {point!r}")


def in_stratum(depth: Column) -> Column:
    return depth.between(lit(k.STRATUM[0]), lit(k.STRATUM[1]))
