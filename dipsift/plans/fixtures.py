"""Views over the given tables that play the roles of the domain tables.

Observations come from ``events``, hosts from its users and ``customer``,
injection tests from ``orders``, benchmark records from ``lineitem``, class
labels from ``labels`` and ``documents``, flattened views from ``embeddings``.
Formulas use integer arithmetic and md5 only, so Spark and DuckDB agree bit for
bit.  ``VIEW_SQL`` holds the DuckDB twin of every view."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipsift.functions import constants as k
from dipsift.functions.expr import fold, lit, uniform

REC_PARTS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
REC_ID_SQL = ("CAST(('0x' || substr(md5(" + " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in REC_PARTS)
              + " || '|' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)), 1, 15)) AS BIGINT)")

CLASS_LIST = "['T','AT','Sin','ASin','L','AL','St','ASt','A']"


def u_sql(seed: str, *key: str) -> str:
    """DuckDB twin of :func:`dipsift.functions.expr.uniform`."""
    text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in key) + f" || '|{seed}'"
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496e0)"


def pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


VIEW_SQL: dict[str, str] = {
    "host": """
        SELECT u.user_id AS tic, 1.5e0 + (u.user_id % 11) * 0.35e0 AS period,
               (u.user_id % 7) * 0.1e0 AS bjd0, 1e0 AS prim_pos,
               2e-2 + (u.user_id % 3) * 1e-2 AS prim_width,
               0.45e0 + (u.user_id % 5) * 2e-2 AS sec_pos,
               CASE WHEN u.user_id % 13 = 0 THEN NULL ELSE 2e-2 + (u.user_id % 4) * 1e-2 END AS sec_width,
               CASE u.user_id % 3 WHEN 0 THEN '1,2;3' WHEN 1 THEN '4, 5' ELSE '' END AS sectors,
               8e0 + abs(c.c_acctbal) / 2e3 AS tmag,
               CASE WHEN u.user_id % 9 = 0 THEN NULL ELSE (u.user_id % 10) / 1e1 END AS morph_coeff,
               0.1e0 + (u.user_id % 5) * 5e-2 AS prim_depth,
               CASE WHEN u.user_id % 13 = 0 THEN NULL ELSE 2e-2 + (u.user_id % 7) * 3e-2 END AS sec_depth
        FROM (SELECT DISTINCT user_id FROM events) u
        LEFT JOIN customer c ON c.c_custkey = u.user_id""",
    "lc": """
        SELECT e.tic, CAST(floor(e.time / 7e0) AS BIGINT) + 1 AS sector, e.time, e.flux, e.flux_err,
               (e.time - h.bjd0) / h.period - floor((e.time - h.bjd0) / h.period) AS phase,
               e.event_id, e.event_type
        FROM (SELECT user_id AS tic,
                     (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10 AS time,
                     1e0 - value / 1e4 AS flux, 1e-3 AS flux_err, event_id, event_type
              FROM events) e
        JOIN host h ON h.tic = e.tic""",
    "tce": f"""
        SELECT e.tic, CAST(floor(e.event_time / 7e0) AS BIGINT) + 1 AS sector, e.event_id, e.event_time,
               (e.event_time - h.bjd0) / h.period - floor((e.event_time - h.bjd0) / h.period) AS phase,
               e.value / 1e4 AS depth, 5e-2 + (e.event_id % 10) * 3e-2 AS duration, e.value / 1e1 AS snr,
               1 + e.event_id % 21 AS n_detrend_detections,
               CASE WHEN 1 + e.event_id % 21 <= 18 THEN 1 ELSE 0 END AS det_dependence,
               CASE WHEN e.event_type = 'error' THEN e.event_id % 2 END AS skye_flag,
               CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS label,
               CASE WHEN e.event_type = 'purchase' THEN 1 + e.event_id % 2 ELSE 0 END AS label_source,
               e.event_id % 2 AS inverted_lc,
               {CLASS_LIST}[CAST(e.event_id % 9 AS INTEGER) + 1] AS best_fit
        FROM (SELECT user_id AS tic, event_id, event_type, value,
                     (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10 AS event_time
              FROM events WHERE value > 60e0) e
        JOIN host h ON h.tic = e.tic""",
    "tests": f"""
        SELECT *, CASE WHEN partner_requested = 1 THEN inj_time + partner_dt END AS partner_time,
               sqrt(inj_depth) AS rp_over_rstar_model
        FROM (SELECT o_orderkey AS model_idx, o_custkey // 10 AS tic,
               1 + CAST(floor({u_sql('sector', 'o_orderkey')} * 5e0) AS BIGINT) AS sector,
               CASE WHEN {u_sql('flip', 'o_orderkey')} < 0.5e0 THEN 1 ELSE 0 END AS inverted_lc,
               (floor({u_sql('sector', 'o_orderkey')} * 5e0)) * 7e0
                 + {u_sql('epoch', 'o_orderkey')} * 7e0 AS inj_time,
               1e-3 + {u_sql('depth', 'o_orderkey')} * 1.4e-2 AS inj_depth,
               5e-2 + {u_sql('duration', 'o_orderkey')} * 0.95e0 AS inj_duration,
               CASE WHEN {u_sql('pair', 'o_orderkey')} < 0.37e0 THEN 1 ELSE 0 END AS partner_requested,
               0.15e0 + {u_sql('dt', 'o_orderkey')} * 2e0 AS partner_dt,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'per_system_' || CAST(o_custkey // 10 AS VARCHAR)
                    WHEN '2-HIGH' THEN 'secondary_all63' ELSE 'aggregate' END AS program
              FROM orders)""",
    "test_events": f"""
        SELECT *, floor({u_sql('score', 'event_id')} * 1e4) / 1e4 AS score FROM (
        SELECT e.model_idx, e.tic, e.sector, e.model_idx * 3 + d.j AS event_id,
               CASE d.j WHEN 0 THEN e.inj_time + ({u_sql('jit0', 'e.model_idx')} - 0.5e0) * 2e0 * e.inj_duration
                    WHEN 1 THEN coalesce(e.partner_time, e.inj_time)
                         + ({u_sql('jit1', 'e.model_idx')} - 0.5e0) * 2e0 * e.inj_duration
                    ELSE e.found_time END AS event_time,
               e.depth, e.duration, e.snr, e.inverted_lc
        FROM (SELECT t.*, c.event_time AS found_time, c.depth, c.duration, c.snr
              FROM tce c JOIN tests t ON t.model_idx = c.event_id) e,
             (VALUES (0), (1), (2)) d(j))""",
    "record": f"""
        SELECT *, floor(({u_sql('score', 'rec_id')} * 0.7e0 + label * 0.3e0) * 1e4) / 1e4 AS score,
               floor(({u_sql('base', 'rec_id')} * 0.9e0 + label * 0.1e0) * 1e4) / 1e4 AS score_base,
               CASE WHEN {u_sql('split', 'tic')} < 0.7e0 THEN 'train'
                    WHEN {u_sql('split', 'tic')} < 0.85e0 THEN 'val' ELSE 'test' END AS split,
               CASE WHEN {u_sql('keep', 'rec_id')} < 0.9e0 THEN 1 ELSE 0 END AS rebalance_keep
        FROM (SELECT {REC_ID_SQL} AS rec_id,
               l_suppkey AS tic, CAST(l_linenumber AS BIGINT) AS sector, l_discount / 1e1 AS depth,
               5e-2 + l_tax * 1.5e1 AS t_dur, l_quantity / 2.5e0 AS snr,
               1 + l_partkey % 21 AS n_detrend_detections,
               CASE WHEN l_linestatus = 'F' THEN l_orderkey % 2 END AS skye_flag,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
               CASE WHEN l_returnflag = 'R' THEN 1 + l_partkey % 2
                    WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS label_source,
               l_partkey % 2 AS inverted_lc,
               {CLASS_LIST}[CAST(l_partkey % 9 AS INTEGER) + 1] AS best_fit,
               l_extendedprice AS price, l_orderkey % 30 AS n_cycles_raw
              FROM lineitem)""",
    "comparator": f"""
        SELECT rec_id AS filename, {CLASS_LIST}[CAST(l_partkey % 9 AS INTEGER) + 1] AS best_fit,
               {", ".join(f"{u_sql(c, 'rec_id')} * 1e2 AS {c}" for c in k.AIC_COLUMNS)},
               {", ".join(f"{u_sql(c, 'rec_id')} * 1e-2 AS {c}" for c in k.RMSE_COLUMNS)}
        FROM (SELECT {REC_ID_SQL} AS rec_id, l_partkey
              FROM lineitem WHERE l_returnflag <> 'N')""",
    "classes": """
        SELECT l.doc_id, l.quality AS label, l.toxic AS inverted, d.source AS stratum
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "crossings": """
        SELECT t.tic AS model, CAST(floor((t.event_time - h.bjd0) / h.period) AS BIGINT) AS cycle,
               3 - t.event_id % 2 * 2 * (CASE WHEN t.event_id % 5 = 0 THEN 1 ELSE 0 END) AS body,
               1 + t.event_id % 2 AS star, t.event_time AS time, t.event_id,
               (t.event_id % 23) / 2e1 - 2e-2 AS impact, t.event_time - t.duration / 2e0 AS ingress,
               t.event_time + t.duration / 2e0 * (CASE WHEN t.event_id % 17 = 0 THEN -1 ELSE 1 END) AS egress,
               h.period, CASE WHEN t.tic % 2 = 0 THEN 'tight' ELSE 'loose' END AS sigma_bin,
               h.sec_depth / h.prim_depth AS depth_ratio, t.depth
        FROM tce t JOIN host h ON h.tic = t.tic""",
    "known": """
        SELECT o_custkey // 10 AS tic, 'p' || CAST(o_orderkey % 3 AS VARCHAR) AS planet, o_orderkey AS known_id,
               (epoch_us(o_orderdate) / 8.64e10) - floor(epoch_us(o_orderdate) / 8.64e10 / 30e0) * 30e0
                 + o_orderkey % 100 / 1e2 AS t_known,
               (o_orderkey % 5) * 5e-2 AS t_unc,
               CASE WHEN o_orderstatus = 'F' THEN 'no' ELSE 'yes, cached' END AS in_window,
               CASE o_orderkey % 3 WHEN 0 THEN 'TESS' WHEN 1 THEN 'Kepler' ELSE 'secondary' END AS mission
        FROM orders""",
}


class Views:
    """Lazily built DataFrames over one directory of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def host(self) -> DataFrame:
        u = F.col("tic")
        customer = self.table("customer").select(F.col("c_custkey").alias("tic"), "c_acctbal")
        return (self.table("events").select(F.col("user_id").alias("tic")).distinct()
                .join(customer, "tic", "left")
                .select("tic", (lit(1.5) + (u % 11) * lit(0.35)).alias("period"),
                        ((u % 7) * lit(0.1)).alias("bjd0"), lit(1).alias("prim_pos"),
                        (lit(2e-2) + (u % 3) * lit(1e-2)).alias("prim_width"),
                        (lit(0.45) + (u % 5) * lit(2e-2)).alias("sec_pos"),
                        F.when(u % 13 != 0, lit(2e-2) + (u % 4) * lit(1e-2)).alias("sec_width"),
                        F.when(u % 3 == 0, "1,2;3").when(u % 3 == 1, "4, 5").otherwise("").alias("sectors"),
                        (lit(8) + F.abs("c_acctbal") / lit(2e3)).alias("tmag"),
                        F.when(u % 9 != 0, (u % 10) / lit(10)).alias("morph_coeff"),
                        (lit(0.1) + (u % 5) * lit(5e-2)).alias("prim_depth"),
                        F.when(u % 13 != 0, lit(2e-2) + (u % 7) * lit(3e-2)).alias("sec_depth")))

    @property
    def ephemeris(self) -> DataFrame:
        return self.host.select("tic", "period", "bjd0")

    @staticmethod
    def _host_formula(df: DataFrame) -> DataFrame:
        """Ephemeris of a system id by formula, so scans need no host join."""
        return df.withColumns({"_period": lit(1.5) + (F.col("tic") % 11) * lit(0.35),
                               "_bjd0": (F.col("tic") % 7) * lit(0.1)})

    def _observed(self) -> DataFrame:
        # Difference of two micros, so the session time zone cancels out.
        micros = (F.unix_micros(F.col("ts").cast("timestamp"))
                  - F.unix_micros(F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)")))
        return self.table("events").select(
            F.col("user_id").alias("tic"), (micros / lit(8.64e10)).alias("time"),
            "value", "event_id", "event_type")

    @cached_property
    def lc(self) -> DataFrame:
        df = self._host_formula(self._observed())
        return df.select(
            "tic", (F.floor(F.col("time") / lit(7)) + 1).alias("sector"), "time",
            (lit(1) - F.col("value") / lit(1e4)).alias("flux"), lit(1e-3).alias("flux_err"),
            fold(F.col("time"), F.col("_bjd0"), F.col("_period")).alias("phase"),
            "event_id", "event_type")

    @cached_property
    def tce(self) -> DataFrame:
        e = F.col("event_id")
        buy = F.col("event_type") == "purchase"
        df = self._host_formula(self._observed().where(F.col("value") > lit(60))
                                .withColumnRenamed("time", "event_time"))
        return df.select(
            "tic", (F.floor(F.col("event_time") / lit(7)) + 1).alias("sector"), "event_id", "event_time",
            fold(F.col("event_time"), F.col("_bjd0"), F.col("_period")).alias("phase"),
            (F.col("value") / lit(1e4)).alias("depth"),
            (lit(5e-2) + (e % 10) * lit(3e-2)).alias("duration"),
            (F.col("value") / lit(10)).alias("snr"),
            (F.lit(1) + e % 21).alias("n_detrend_detections"),
            F.when(F.lit(1) + e % 21 <= k.DETREND_ROBUST_ABOVE, 1).otherwise(0).alias("det_dependence"),
            F.when(F.col("event_type") == "error", e % 2).alias("skye_flag"),
            F.when(buy, 1).otherwise(0).alias("label"),
            F.when(buy, 1 + e % 2).otherwise(0).alias("label_source"),
            (e % 2).alias("inverted_lc"), pick(k.BEST_FIT_CLASSES, e % 9).alias("best_fit"))

    @cached_property
    def tests(self) -> DataFrame:
        o = F.col("o_orderkey")
        sector0 = F.floor(uniform("sector", o) * lit(5))
        tic = F.floor(F.col("o_custkey") / 10)
        return self.table("orders").select(
            o.alias("model_idx"), tic.alias("tic"), (sector0 + 1).alias("sector"),
            F.when(uniform("flip", o) < lit(0.5), 1).otherwise(0).alias("inverted_lc"),
            (sector0 * lit(7) + uniform("epoch", o) * lit(7)).alias("inj_time"),
            (lit(1e-3) + uniform("depth", o) * lit(1.4e-2)).alias("inj_depth"),
            (lit(5e-2) + uniform("duration", o) * lit(0.95)).alias("inj_duration"),
            F.when(uniform("pair", o) < lit(k.PAIR_RATE), 1).otherwise(0).alias("partner_requested"),
            (lit(0.15) + uniform("dt", o) * lit(2)).alias("partner_dt"),
            F.when(F.col("o_orderpriority") == "1-URGENT",
                   F.concat(F.lit("per_system_"), tic.cast("string")))
             .when(F.col("o_orderpriority") == "2-HIGH", "secondary_all63")
             .otherwise("aggregate").alias("program"),
        ).withColumns({
            "partner_time": F.when(F.col("partner_requested") == 1,
                                   F.col("inj_time") + F.col("partner_dt")),
            "rp_over_rstar_model": F.sqrt("inj_depth")})

    @cached_property
    def test_events(self) -> DataFrame:
        """Events flagged in each test: near the lead, near the partner, elsewhere."""
        m = F.col("model_idx")
        found = self.tce.select(F.col("event_id").alias("model_idx"), F.col("event_time").alias("found_time"),
                                "depth", "duration", "snr")
        rows = self.tests.join(found, "model_idx")
        near = {j: (uniform(f"jit{j}", m) - lit(0.5)) * lit(2) * F.col("inj_duration") for j in (0, 1)}
        times = F.array(F.col("inj_time") + near[0],
                        F.coalesce("partner_time", "inj_time") + near[1], F.col("found_time"))
        return (rows.select("model_idx", "tic", "sector", F.posexplode(times).alias("_j", "event_time"),
                            "depth", "duration", "snr", "inverted_lc")
                .withColumn("event_id", m * 3 + F.col("_j")).drop("_j")
                .withColumn("score", F.floor(uniform("score", F.col("event_id")) * lit(1e4)) / lit(1e4)))

    def _rec_id(self) -> Column:
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in REC_PARTS],
                           F.col("l_quantity").cast("bigint").cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

    @cached_property
    def record(self) -> DataFrame:
        p = F.col("l_partkey")
        returned, final = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
        r, s = F.col("rec_id"), uniform("split", F.col("tic"))
        return self.table("lineitem").select(
            self._rec_id().alias("rec_id"), F.col("l_suppkey").alias("tic"),
            F.col("l_linenumber").cast("bigint").alias("sector"),
            (F.col("l_discount") / lit(10)).alias("depth"),
            (lit(5e-2) + F.col("l_tax") * lit(15)).alias("t_dur"),
            (F.col("l_quantity") / lit(2.5)).alias("snr"),
            (F.lit(1) + p % 21).alias("n_detrend_detections"),
            F.when(final, F.col("l_orderkey") % 2).alias("skye_flag"),
            F.when(returned, 1).otherwise(0).alias("label"),
            F.when(returned, 1 + p % 2).when(final, 0).otherwise(1).alias("label_source"),
            (p % 2).alias("inverted_lc"), pick(k.BEST_FIT_CLASSES, p % 9).alias("best_fit"),
            F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") % 30).alias("n_cycles_raw"),
        ).withColumns({
            "score": F.floor((uniform("score", r) * lit(0.7) + F.col("label") * lit(0.3)) * lit(1e4)) / lit(1e4),
            "score_base": F.floor((uniform("base", r) * lit(0.9) + F.col("label") * lit(0.1)) * lit(1e4)) / lit(1e4),
            "split": F.when(s < lit(0.7), "train").when(s < lit(0.85), "val").otherwise("test"),
            "rebalance_keep": F.when(uniform("keep", r) < lit(0.9), 1).otherwise(0)})

    @cached_property
    def comparator(self) -> DataFrame:
        f = F.col("filename")
        return (self.table("lineitem").where(F.col("l_returnflag") != "N")
                .select(self._rec_id().alias("filename"),
                        pick(k.BEST_FIT_CLASSES, F.col("l_partkey") % 9).alias("best_fit"))
                .select("filename", "best_fit",
                        *[(uniform(c, f) * lit(100)).alias(c) for c in k.AIC_COLUMNS],
                        *[(uniform(c, f) * lit(1e-2)).alias(c) for c in k.RMSE_COLUMNS]))

    @cached_property
    def classes(self) -> DataFrame:
        return (self.table("labels")
                .join(self.table("documents").select("doc_id", "source"), "doc_id")
                .select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("inverted"),
                        F.col("source").alias("stratum")))

    @cached_property
    def crossings(self) -> DataFrame:
        e = F.col("event_id")
        return self.tce.join(self.host, "tic").select(
            F.col("tic").alias("model"),
            F.floor((F.col("event_time") - F.col("bjd0")) / F.col("period")).alias("cycle"),
            (F.lit(3) - e % 2 * 2 * F.when(e % 5 == 0, 1).otherwise(0)).alias("body"),
            (1 + e % 2).alias("star"), F.col("event_time").alias("time"), "event_id",
            ((e % 23) / lit(20) - lit(2e-2)).alias("impact"),
            (F.col("event_time") - F.col("duration") / lit(2)).alias("ingress"),
            (F.col("event_time") + F.col("duration") / lit(2)
             * F.when(e % 17 == 0, -1).otherwise(1)).alias("egress"),
            "period", F.when(F.col("tic") % 2 == 0, "tight").otherwise("loose").alias("sigma_bin"),
            (F.col("sec_depth") / F.col("prim_depth")).alias("depth_ratio"), "depth")

    @cached_property
    def known(self) -> DataFrame:
        o = F.col("o_orderkey")
        days = (F.unix_micros(F.col("o_orderdate").cast("timestamp"))
                - F.unix_micros(F.expr("cast(timestamp_ntz'1970-01-01 00:00:00' as timestamp)"))) / lit(8.64e10)
        return self.table("orders").select(
            F.floor(F.col("o_custkey") / 10).alias("tic"),
            F.concat(F.lit("p"), (o % 3).cast("string")).alias("planet"), o.alias("known_id"),
            (days - F.floor(days / lit(30)) * lit(30) + (o % 100) / lit(100)).alias("t_known"),
            ((o % 5) * lit(5e-2)).alias("t_unc"),
            F.when(F.col("o_orderstatus") == "F", "no").otherwise("yes, cached").alias("in_window"),
            F.when(o % 3 == 0, "TESS").when(o % 3 == 1, "Kepler").otherwise("secondary").alias("mission"))
