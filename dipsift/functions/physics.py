"""Host orbit quantities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import clip, frac, lit, uniform


def eccentricity(prim_pos: Column, sec_pos: Column, prim_width: Column,
                 sec_width: Column) -> tuple[Column, Column, Column]:
    """(e cos w, e sin w, e) from eclipse spacing and widths; NULL without both
    positions, no sine term without usable widths."""
    ec = lit(math.pi / 2) * (frac(sec_pos - prim_pos) - lit(0.5))
    total = sec_width + prim_width
    es = F.coalesce(F.when(total > 0, (sec_width - prim_width) / total), lit(0))
    es = F.when(ec.isNotNull(), es)
    return ec, es, F.when(ec.isNotNull(),
                          F.least(F.sqrt(ec * ec + es * es), lit(k.ECCENTRICITY_CAP)))


def critical_axis_ratio(e: Column, mu: float = k.MASS_FRACTION) -> Column:
    """Smallest stable orbit in units of the binary's axis (empirical fit)."""
    e = clip(e, 0.0, k.AXIS_FIT_MAX_ECC)
    return (lit(1.60) + lit(5.10) * e - lit(2.22) * e * e + lit(4.12 * mu)
            - lit(4.27 * mu) * e - lit(5.09 * mu * mu) + lit(4.61 * mu * mu) * e * e)


def critical_period(period: Column, e: Column) -> Column:
    return period * F.pow(critical_axis_ratio(e), lit(1.5))


def planet_period(p_crit: Column, seed: str, *key: Column, tail: float = 0.20) -> Column:
    """Log-uniform above the stability limit, with a longer-period tail."""
    span = F.when(uniform(seed + ".tail", *key) < lit(tail), lit(1.0)) \
            .otherwise(lit(math.log10(3.0)))
    return p_crit * F.pow(lit(10), uniform(seed + ".pp", *key) * span)


def same_star_multiple_allowed(p_planet: Column, p_bin: Column, q: float = 0.3) -> Column:
    return F.coalesce((p_planet > p_bin * lit((1.0 / q + 1.0) ** 3)), F.lit(False)).cast("double")
