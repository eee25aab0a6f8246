"""Injected flux beside plain Python; copies of curves are not shuffled to their deltas."""
import random

import pytest

from dipsift.functions import constants as k
from dipsift.operators import injection

LC = "tic bigint, sector bigint, time double, flux double, phase double, cadence_id bigint"
TESTS = "tic bigint, sector bigint, model_idx bigint, inverted_lc int"
TRANSITS = "tic bigint, sector bigint, model_idx bigint, centre double, transit_duration double, transit_depth double"


def test_injected_flux_equals_plain_python_with_two_joins(spark):
    rnd = random.Random(3)
    lc = [(t, s, rnd.random() * 7, 1 + rnd.gauss(0, 1e-3), 0.5, 1000 * t + 100 * s + i) for t in (1, 2) for s in (1, 2) for i in range(40)]
    tests = [(1 + m % 2, 1 + m // 2 % 3, m, m % 2) for m in range(12)]
    transits = [(t, s, m, rnd.random() * 7, rnd.choice([0.0, 0.5, 2.0]), 0.01) for t, s, m, _ in tests for _ in range(m % 4)]
    transits.append((1, 1, 0, 3.0, None, 0.01))
    got = injection.injected_curves(spark.createDataFrame(lc, LC), spark.createDataFrame(tests, TESTS), spark.createDataFrame(transits, TRANSITS), "cadence_id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # the copies, and a test with its transits
    want = {}
    for t, s, m, inverse in tests:
        for tic, sector, time, flux, _, key in lc:
            if (tic, sector) == (t, s):
                delta = 0.0
                for *_, owner, centre, duration, depth in transits:
                    if owner == m and duration and abs(time - centre) <= duration / 2:
                        delta -= depth * (1 - k.INJECTION_CURVATURE * ((time - centre) / (duration / 2)) ** 2)
                want[m, key] = (((flux - 1) * -1) + 1 if inverse else flux) + delta
    rows = {(r.model_idx, r.cadence_id): r.flux for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[x] == pytest.approx(want[x], abs=1e-12) for x in want)
