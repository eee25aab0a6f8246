"""Exact order statistics over whole tables: cumulative counts, quantiles,
ranks, ROC-AUC, average precision, two-sample KS.

Equal values are merged first (map-side combine).  The merged rows are cut into ranges of
(keys, value) at splitters that Spark samples from the values themselves, so an outlier or a
dense spot crowds no range; exact counts check that, and a table with an overfull range is
cut again, finer.  Only range totals are scanned across the table, so neither
a global sort nor an unpartitioned window over raw rows is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import lit
from dipsift.operators.lineage import materialise
from dipsift.operators.skew import attach

#: Rows that a range should hold; no range holds more than twice as many.
RANGE_ROWS = 1_000_000


def scalar(df: DataFrame, column: Column) -> Column:
    """A one-row result as an in-plan constant (scalar subquery)."""
    return df.select(column).scalar()


def ranges(df: DataFrame, order: Sequence[str | Column], share: int = RANGE_ROWS) -> DataFrame:
    """``df`` written once, with the number ``_b`` of its range in ``order``.

    Small tables become few ranges (adaptive coalescing joins neighbours); a table with a range of
    more than twice the ``share`` is dealt again by its row count, finer until none is left.  ``order`` must
    tell rows apart, or as many equal ones as a range may hold stay together."""
    placed = materialise(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranges")
    parts = 0
    while True:
        sizes = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).first()
        if (sizes["most"] or 0) <= 2 * share or parts > sizes["total"]:
            return placed
        parts = max(2 * parts, -(-sizes["total"] // share), 2 * sizes["parts"] if parts else 0)
        placed = materialise(placed.drop("_b").repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()), "ranges")


def _merged(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """Ranges of the distinct values of each key with their summed measures."""
    return ranges(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(c).alias(m) for m, c in measures.items()]), [*keys, value])


def _prefix(placed: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Totals of all lower ranges and of the key; a key has one row for each range it reaches into."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.groupBy(*keys, "_b").agg(*[F.sum(m).alias(m) for m in names])
            .select(*keys, "_b", *[F.col(m).alias(f"{m}_in") for m in names],
                    *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"{m}_lower")
                      for m in names],
                    *[F.sum(m).over(group).alias(f"{m}_total") for m in names]))


def cumulative(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per distinct value: each measure ``m`` there, ``m_below`` strictly
    below it and ``m_total`` over the key."""
    names = list(measures)
    b = _merged(df, keys, value, measures)
    inner = (Window.partitionBy(*keys, "_b").orderBy(value)
             .rowsBetween(Window.unboundedPreceding, -1))
    return (b.join(_prefix(b, keys, names), [*keys, "_b"])
            .select(*keys, value, *names, *[f"{m}_total" for m in names],
                    *[(F.col(f"{m}_lower") + F.coalesce(F.sum(m).over(inner), F.lit(0)))
                      .alias(f"{m}_below") for m in names]))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float | str],
              prob_table: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles per key by linear interpolation between order statistics
    ``floor`` and ``ceil`` of ``(n - 1) * q``, plus ``n``.

    A probability given as a string is a column of ``prob_table``, a small table
    joined by ``on`` (a subset of ``keys``): data-dependent quantiles stay in the
    plan.  Only the ranges that hold a wanted position are ordered."""
    out = order_statistics(df, keys, value, list(probs.values()), prob_table, on)
    if prob_table is not None:
        out = out.join(prob_table, list(on))
    return out.select(*keys, "n", *[interpolated(q).alias(name) for name, q in probs.items()])


def interpolated(q: float | str | Column, cap: Column | None = None) -> Column:
    """Quantile ``q`` from the columns ``n`` and ``_at`` of :func:`order_statistics`,
    optionally with the order statistics capped first."""
    prob = q if isinstance(q, Column) else F.col(q) if isinstance(q, str) else lit(q)
    h = (F.col("n") - F.lit(1)) * prob
    lo = F.element_at("_at", F.floor(h).cast("bigint"))
    hi = F.element_at("_at", F.ceil(h).cast("bigint"))
    if cap is not None:
        lo, hi = F.least(lo, cap), F.least(hi, cap)
    return lo + (hi - lo) * (h - F.floor(h))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float | str],
                     prob_table: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Per key ``n`` and the map ``_at`` from the positions the quantiles need to
    the values there."""
    b = _merged(df, keys, value, {"_c": F.lit(1).cast("bigint")})
    pre = _prefix(b, keys, ["_c"])

    def with_probs(t: DataFrame) -> DataFrame:
        return t if prob_table is None else t.join(prob_table, list(on))

    def position(q: float | str, n: str) -> Column:
        return (F.col(n) - F.lit(1)) * (F.col(q) if isinstance(q, str) else lit(q))

    spots = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(position(q, "_c_total")).cast("bigint"), F.ceil(position(q, "_c_total")).cast("bigint"))
        for q in probs])))
    lower, inside = F.col("_c_lower"), F.col("_c_in")
    wanted = (with_probs(pre).withColumn("_spots", spots)
              .where(F.exists("_spots", lambda s: (s >= lower) & (s < lower + inside)))
              .select(*keys, "_b", "_c_lower", "_c_total", "_spots"))
    inner = (Window.partitionBy(*keys, "_b").orderBy(value)
             .rowsBetween(Window.unboundedPreceding, -1))
    below = F.col("_c_lower") + F.coalesce(F.sum("_c").over(inner), F.lit(0))
    hits = (b.join(wanted, [*keys, "_b"]).withColumn("_below", below)
            .select(*keys, value, "_c_total", F.explode(F.filter("_spots", lambda s: (
                s >= F.col("_below")) & (s < F.col("_below") + F.col("_c")))).alias("_spot")))
    return hits.groupBy(*keys).agg(
        F.max("_c_total").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_spot", value))).alias("_at"))


def median_mad(df: DataFrame, keys: Sequence[str], value: str, spread: Sequence[str]) -> DataFrame:
    """Per key: ``n``, ``med`` and ``mad`` (median absolute deviation)."""
    med = quantiles(df, keys, value, {"med": 0.5})
    dev = (attach(df.where(F.col(value).isNotNull()), med, keys, spread, "inner")
           .withColumn("_dev", F.abs(F.col(value) - F.col("med"))))
    mad = quantiles(dev, keys, "_dev", {"mad": 0.5}).drop("n")
    return med.join(mad, list(keys))


def ranked(df: DataFrame, value: str, tie: Sequence[str], name: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Position 1..n in (value descending, tie ascending) order, per key if any, without
    a single task sort: rows are numbered within ranges of that order, ties included, and
    range totals are added up.  Rows without a value have no position and are left out."""
    order = [F.desc(value), *tie]
    placed = ranges(df.where(F.col(value).isNotNull()), [*keys, *order])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_b", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (placed.withColumn("_i", F.row_number().over(inner)).join(offsets, [*keys, "_b"])
            .withColumn(name, F.col("_offset") + F.col("_i")).drop("_b", "_i", "_offset"))


def ranking_quality(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """ROC-AUC (ties half), its folded form, step average precision with ties
    grouped, the prior and the lift over it; one row per key."""
    c = cumulative(df.where(F.col(label).isNotNull()), keys, score,
                   {"pos": F.col(label).cast("bigint"), "all": F.lit(1).cast("bigint")})
    neg, neg_below = F.col("all") - F.col("pos"), F.col("all_below") - F.col("pos_below")
    hits = F.col("pos_total") - F.col("pos_below")
    kept = F.col("all_total") - F.col("all_below")
    out = c.groupBy(*keys).agg(
        F.sum(F.col("pos") * (neg_below + neg / lit(2))).alias("_u"),
        F.sum(F.col("pos") * (hits / kept)).alias("_ap"),
        F.max("pos_total").alias("n_pos"), F.max("all_total").alias("n"))
    n_pos, n_neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return (out.withColumn("roc_auc", F.when((n_pos > 0) & (n_neg > 0), F.col("_u") / (n_pos * n_neg)))
            .withColumn("auc_folded", F.greatest("roc_auc", lit(1) - F.col("roc_auc")))
            .withColumn("average_precision", F.when(n_pos > 0, F.col("_ap") / n_pos))
            .withColumn("prior", n_pos / F.col("n"))
            .withColumn("lift", F.col("average_precision") - F.col("prior"))
            .drop("_u", "_ap"))


def ks_two_sample(df: DataFrame, keys: Sequence[str], value: str, is_first: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the asymptotic p-value."""
    c = cumulative(df, keys, value, {"a": is_first.cast("bigint"),
                                     "b": (~is_first).cast("bigint")})
    d = F.abs((F.col("a_below") + F.col("a")) / F.col("a_total")
              - (F.col("b_below") + F.col("b")) / F.col("b_total"))
    out = c.groupBy(*keys).agg(F.max(d).alias("ks"), F.max("a_total").alias("n_first"),
                               F.max("b_total").alias("n_second"))
    n, m = F.col("n_first"), F.col("n_second")
    lam = F.col("ks") * F.sqrt(n * m / (n + m))
    series = lit(0)
    for j in range(1, 31):
        series = series + lit(2.0 * (-1) ** (j - 1)) * F.exp(lit(-2.0 * j * j) * lam * lam)
    # The alternating series only converges for lam > 0; tiny lam means p = 1.
    p = F.when(lam < lit(0.2), lit(1.0)).otherwise(F.least(F.greatest(series, lit(0)), lit(1)))
    return out.withColumn("p_value", p)


def top_by_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys (ties by key)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.desc("n_rows"), key).limit(n))


def mde(p, n: Column, z: float = k.MDE_Z) -> Column:
    """Smallest detectable difference of two proportions over ``n`` independent units."""
    p = p if isinstance(p, Column) else lit(p)
    return F.when(n > 0, lit(z) * F.sqrt(lit(2) * p * (lit(1) - p) / n))
