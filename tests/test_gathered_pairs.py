"""Pairs of an event that meet in one place, and dense views filled by batch."""

import random

import pytest
from pyspark.sql import functions as F

from dipsift.operators import record, skew, views


@pytest.fixture(scope="module")
def curve(spark):
    r = random.Random(5)
    rows = []
    for tic in range(3):
        for _ in range(400 if tic else 60):
            t = r.uniform(0, 28)
            rows.append((tic, int(t // 7) + 1, t, 1 - r.uniform(0, 0.02), (t / (1.5 + tic)) % 1, len(rows)))
    return spark.createDataFrame(rows, "tic bigint, sector bigint, time double, flux double, phase double, cadence bigint").cache()


@pytest.fixture(scope="module")
def events(spark, curve):
    return (curve.where("cadence % 3 = 0").withColumnRenamed("cadence", "event_id").withColumnRenamed("time", "event_time")
            .select("tic", "sector", "event_id", "event_time", "phase", F.lit(0.01).alias("depth"),
                    (F.lit(0.05) + F.col("event_id") % 7 * 0.06).alias("duration"), (F.lit(1.5) + F.col("tic")).alias("period"))).cache()


def places(df, place):
    return df.groupBy("event_id").agg(F.countDistinct(*place).alias("n")).agg(F.max("n")).first()[0]


def test_gathered_windows_hold_the_same_pairs_in_one_place(curve, events):
    lc, ev = curve.drop("phase"), events.drop("phase")
    old = views.event_windows(lc, ev, ["cadence"]).select("event_id", "cadence")
    new = views.gathered_windows(lc, ev)
    assert sorted(map(tuple, new.select("event_id", "cadence").collect())) == sorted(map(tuple, old.collect()))
    assert places(new, views.WINDOW_PLACE) == 1


@pytest.mark.parametrize("together", [1024, 7])
def test_gathered_folds_hold_the_same_pairs_in_one_place(curve, events, monkeypatch, together):
    defaults = list(skew.arc_join.__defaults__)
    monkeypatch.setattr(skew.arc_join, "__defaults__", tuple([*defaults[:-1], together]))
    old = views.fold_pairs(curve, events.drop("sector"), ["cadence"]).select("event_id", "cadence", "cycle", "in_window")
    new = views.fold_pairs(curve, events.drop("sector"), ["cadence"], gathered=True)
    assert sorted(map(tuple, new.select("event_id", "cadence", "cycle", "in_window").collect())) == sorted(map(tuple, old.collect()))
    assert places(new, views.FOLD_PLACE) == 1
    assert (new.select("_way").distinct().count() > 1) == (together == 7)


def test_pairs_are_not_shuffled_by_event(spark, curve, events):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, by, _, stack = record.event_pairs(curve, events, "cadence")
        plan = views.recurrence_scalars(stack, record.STACK_KEY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan[:plan.index("SortMergeJoin")]
    assert "Exchange" not in top


def test_dense_fills_batches(spark):
    df = spark.createDataFrame([(1, [(0, 0.5, 1), (3, 2.5, 1)]), (2, None), (3, []), (4, [(1, -1.0, 2)])],
                               "event_id bigint, v array<struct<bin:int,value:double,valid:int>>")
    got = {r["event_id"]: r["v"] for r in views.dense(df, {"v": (4, ["value", "valid"])}).collect()}
    none = [[0.0] * 4, [0.0] * 4]
    assert got == {1: [[0.5, 0, 0, 2.5], [1, 0, 0, 1]], 2: none, 3: none, 4: [[0, -1, 0, 0], [0, 2, 0, 0]]}
