"""The campaign chain: planted dips, broken curves, placements by parameter, interrupted runs."""

import pytest
from pyspark.sql import functions as F

from dipsift.functions.expr import lit, uniform
from dipsift.operators import chain, search

CADENCE = 0.02


@pytest.fixture(scope="module")
def source(spark):
    n = 500
    cad = spark.range(5 * n).select((F.col("id") / n).cast("long").alias("tic"), F.lit(1).cast("long").alias("sector"), (F.col("id") % n * lit(CADENCE)).alias("time"),
                                    (lit(1) + (uniform("noise", F.col("id")) - lit(0.5)) * lit(2e-5)).alias("flux"), lit(0.3).alias("phase"), F.col("id").alias("cadence_id"))
    # System 3 has a broken value, system 4 three cadences only.
    cad = cad.withColumn("flux", F.when((F.col("tic") == 3) & (F.col("cadence_id") % 97 == 0), float("nan")).otherwise(F.col("flux"))).where("tic < 4 OR time < 0.05")
    cad = spark.createDataFrame(cad.toPandas())
    events = spark.createDataFrame([(0, 1, 1, 4.0, 0.4), (1, 1, 2, 2.0, 30.0)], "tic long, sector long, event_id long, event_time double, duration double")
    hosts = spark.createDataFrame([(t, 12.0, 40.0, 0.8) for t in range(4)], "tic long, period double, p_crit double, depth_ratio double")
    return chain.Source(cad, cad.select("tic", "sector", "time").where("time > 1 AND time < 9"), events, hosts,
                        searched={"lengths": search.window_lengths(3), "max_step": 0.5, "cadence": CADENCE, "tolerance": 0.1})


@pytest.fixture(scope="module")
def tests_(spark):
    rows = [(k, (0, 1, 2, 3, 4, 9)[k % 6], True, 0.01, 0.2, k % 2) for k in range(48)]
    return spark.createDataFrame(rows, "model_idx long, tic long, per_system boolean, inj_depth double, inj_duration double, partner_requested int")


@pytest.fixture(scope="module")
def whole(source, tests_):
    return {r.model_idx: r for r in chain.campaign(tests_, source, chain.anywhere("e")).collect()}


def test_failures_are_rows_and_dips_are_found(whole):
    assert sorted(whole) == list(range(48))
    by_tic = lambda t: [r for k, r in whole.items() if (0, 1, 2, 3, 4, 9)[k % 6] == t]
    assert {r.reason for r in by_tic(3)} == {"values not finite"} and {r.reason for r in by_tic(4)} == {"too few cadences"}
    assert {r.reason for r in by_tic(9)} == {"no curve"} and {r.state for r in by_tic(9)} == {"failed"}
    for r in by_tic(1):  # one event covers the native curve
        assert (r.reason, r.n_blocked > 0) == (("no free epoch", True) if r.inverted_lc == 0 else (None, False))
    done = [r for r in whole.values() if r.state == "done"]
    assert {r.inverted_lc for r in done} == {0, 1} and all(r.recovered == 1 for r in done if 1.6 < r.inj_time < 8.4)
    for r in by_tic(0):
        if r.inverted_lc == 0:
            assert abs(r.inj_time - 4.0) >= 0.3
    pairs = [r for r in done if r.partner_state == "injected"]
    assert all(0 <= r.partner_time <= 10 for r in pairs) and len({r.partner_ratio for r in pairs}) == len(pairs)
    assert {r.partner_state for k, r in whole.items() if k % 2 == 0} == {"none"}


def test_interrupted_run_equals_a_whole_one(spark, source, tests_, whole, tmp_path):
    bounds, runs = [(0, 20), (20, 48)], []

    def run(part):
        runs.append(part.count())
        if len(runs) == 2:
            raise RuntimeError("lost")
        return chain.campaign(part, source, chain.anywhere("e"))
    with pytest.raises(RuntimeError):
        chain.run_ranges(tests_, bounds, str(tmp_path), run)
    assert list(chain.finished(spark, str(tmp_path))) == [(0, 20)]
    again = {r.model_idx: r for r in chain.run_ranges(tests_, bounds, str(tmp_path), run).collect()}
    assert again == whole and runs == [20, 28, 28]


def test_placements_are_parameters(spark, source, tests_, monkeypatch):
    tests = tests_.where("model_idx % 6 = 2")

    def first(cadences, rows):
        return cadences.groupBy("model_idx").agg(F.min("time").alias("inj_time"))
    got = chain.campaign(tests, source, first).collect()
    assert {round(r.inj_time, 6) for r in got} == {1.02}
    binned = chain.Source(source.cadences, source.eligible.withColumn("bin", F.when(F.col("time") < 5, 0).otherwise(1).cast("bigint")), source.events, source.hosts,
                          source.least, source.searched)
    histogram = spark.createDataFrame([(0, 0), (1, 7)], "bin bigint, n bigint")
    got = chain.campaign(tests, binned, chain.like_histogram("h", histogram)).collect()
    assert len(got) == 8 and all(r.inj_time >= 5 for r in got)
