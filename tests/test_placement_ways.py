"""Placement draws beside the bins of a curve, without rows of tries."""

from pyspark.sql import functions as F

from dipsift.operators import injection


def test_busy_curves_go_several_ways_and_tries_are_no_rows(spark):
    cadences = spark.createDataFrame([(c % 3, 1, c * 0.13, c % 11) for c in range(200)], "tic bigint, sector bigint, time double, bin bigint")
    histogram = spark.createDataFrame([(b, b % 4) for b in range(20)], "bin bigint, n bigint")
    tests = spark.createDataFrame([(m, 0 if m % 10 else m % 4, 1) for m in range(300)], "model_idx bigint, tic bigint, sector bigint")
    one, several = (injection.matched_epochs(cadences, histogram, tests, "ways", 5, together=n) for n in (1000, 20))
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, several.collect()))
    assert len(rows) == tests.where("tic < 3").count()
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "try4" in plan


def test_an_empty_histogram_leaves_any_cadence(spark):
    cadences = spark.createDataFrame([(1, 1, float(c), c % 2) for c in range(10)], "tic bigint, sector bigint, time double, bin bigint")
    tests = spark.createDataFrame([(m, 1, 1) for m in range(20)], "model_idx bigint, tic bigint, sector bigint")
    histogram = spark.createDataFrame([(0, 0)], "bin bigint, n bigint")
    got = injection.matched_epochs(cadences, histogram, tests, "none", 3)
    assert {r[0] for r in got.select(F.col("outcome")).distinct().collect()} == {"uniform"} and got.count() == 20
