"""Placement draws and capped stacks against brute force."""
import math

import pytest
from pyspark.sql import functions as F

from dipsift.functions.expr import uniform
from dipsift.operators import injection, sampling, views

CADENCES = "tic bigint, sector bigint, time double, bin bigint"
TESTS = "tic bigint, sector bigint, model_idx bigint"


def draws_of(spark, tests, seed, tries):
    cols = [uniform(f"{seed}.try{a}", F.col("model_idx")) for a in range(tries)]
    rows = tests.select("model_idx", *[c.alias(f"t{a}") for a, c in enumerate(cols)],
                        uniform(f"{seed}.fall", F.col("model_idx")).alias("uf"), uniform(f"{seed}.pick", F.col("model_idx")).alias("up"))
    return {r["model_idx"]: ([r[f"t{a}"] for a in range(tries)], r["uf"], r["up"]) for r in rows.collect()}


def pick(weights, u):
    target, run = math.floor(u * sum(w for _, w in weights)), 0
    for b, w in weights:
        run += w
        if run > target:
            return b
    return None


def brute(cadences, histogram, tests, draws):
    out = {}
    for tic, sector, key in tests:
        own = sorted((b, t) for a, s, t, b in cadences if (a, s) == (tic, sector))
        if not own:
            continue
        have = {b: [t for x, t in own if x == b] for b in sorted({b for b, _ in own})}
        tries, uf, up = draws[key]
        hits = [(a, b) for a, b in enumerate(pick(sorted(histogram), u) for u in tries) if b in have]
        mass = [(b, dict(histogram).get(b, 0)) for b in have]
        if hits:
            outcome, b = ("bin_hit" if hits[0][0] == 0 else "redraw"), hits[0][1]
        elif any(m for _, m in mass):
            outcome, b = "nearest", pick(mass, uf)
        else:
            outcome, b = "uniform", pick([(b, len(ts)) for b, ts in have.items()], uf)
        out[key] = (outcome, b, have[b][math.floor(up * len(have[b]))])
    return out


@pytest.mark.parametrize("histogram", [
    [(0, 5), (1, 0), (2, 90), (3, 1), (4, 4)],
    [(0, 0), (1, 0), (2, 0)],
    [(7, 1000), (1, 1)],
    [],
])
def test_bin_first_draws_equal_brute_force(spark, histogram):
    cadences = [(1, 1, i * 0.5, i % 5) for i in range(60)] + [(1, 2, 3.0, 1), (2, 1, 9.0, 6), (2, 1, 9.5, 6), (3, 1, 1.0, 2)]
    # One curve holds most of the tests; curve (4, 1) has no cadence.
    tests = [(1, 1, i) for i in range(120)] + [(1, 2, 200), (1, 2, 201), (2, 1, 300), (2, 1, 301), (3, 1, 400), (4, 1, 500)]
    t = spark.createDataFrame(tests, TESTS)
    got = injection.matched_epochs(spark.createDataFrame(cadences, CADENCES), spark.createDataFrame(histogram, "bin bigint, n bigint"), t, "s", 4)
    found = {r["model_idx"]: (r["outcome"], r["bin"], r["inj_time"]) for r in got.collect()}
    assert found == brute(cadences, histogram, tests, draws_of(spark, t, "s", 4))


def test_draws_without_tests_or_cadences(spark):
    h = spark.createDataFrame([(0, 1)], "bin bigint, n bigint")
    one = spark.createDataFrame([(1, 1, 0.5, 0)], CADENCES)
    assert injection.matched_epochs(one, h, spark.createDataFrame([], TESTS), "s", 3).count() == 0
    assert injection.matched_epochs(spark.createDataFrame([], CADENCES), h, spark.createDataFrame([(1, 1, 1)], TESTS), "s", 3).count() == 0


@pytest.fixture(scope="module")
def curve(spark):
    """41-day orbit over four years with holes; three events, budgets of 2, 0 and 500 cycles."""
    period, rows = 41.079, []
    for i in range(0, 1471 * 8):
        t = 120 + i / 8
        if (t - 120) % 90 < 85:
            rows.append((1, int(t // 400), t, 1.0 - 0.01 * (abs((t - 532.3 + period / 2) % period - period / 2) < 0.4), (t / period) % 1, i))
    lc = spark.createDataFrame(rows, "tic bigint, sector bigint, time double, flux double, phase double, cadence bigint")
    ev = spark.createDataFrame([(1, e, t, (t / period) % 1, 0.01, 0.6, period) for e, t in ((2, 532.3), (0, 860.932), (500, 1025.248))],
                               "tic bigint, event_id bigint, event_time double, phase double, depth double, duration double, period double")
    return lc.cache(), ev, rows, period


def scalars(spark, curve, capped):
    lc, ev, *_ = curve
    scatter = spark.createDataFrame([(e, 1e-4) for e in (2, 0, 500)], "event_id bigint, local_scatter double")
    stack = views.stacked(views.fold_pairs(lc, ev, ["cadence"], capped), scatter, ["event_id"])
    return {r["event_id"]: r for r in views.recurrence_scalars(stack, ["event_id"]).collect()}


def test_capped_cycles_lie_below_uncapped(spark, curve):
    lc, ev, _, _ = curve
    caps = sampling.cycle_caps(sampling.chosen_cycles(lc, ev, F.col("event_id"), "cap"))
    free, held = scalars(spark, curve, None), scalars(spark, curve, caps)
    assert held[2]["n_cycles_raw"] <= 2 < free[2]["n_cycles_raw"]
    assert 0 not in held and free[0]["n_cycles_raw"] > 20
    # A budget above the number of cycles changes nothing.
    assert held[500] == free[500]


def test_capped_pairs_equal_a_filter_of_all_pairs(spark, curve):
    lc, ev, rows, period = curve
    kept = {(r["event_id"], r["cycle"]) for r in sampling.chosen_cycles(lc, ev, F.col("event_id"), "cap").where("kept = 1").collect()}
    assert len([c for e, c in kept if e == 2]) == 2
    caps = sampling.cycle_caps(sampling.chosen_cycles(lc, ev, F.col("event_id"), "cap"))
    got = {(r["event_id"], r["time"]) for r in views.fold_pairs(lc, ev, ["cadence"], caps).select("event_id", "time").collect()}
    every = views.fold_pairs(lc, ev, ["cadence"]).select("event_id", "time", "event_time").collect()

    def sees(e, t, t0):
        orbit = math.floor((t - t0) / period + 0.5)
        return abs(t - t0) <= 1.8 or orbit == 0 or (e, orbit) in kept
    assert got == {(r["event_id"], r["time"]) for r in every if sees(*r)}
