"""Copies of short curves are searched where they are made; what is found equals the search by shards of time."""
import random

import pytest

from dipsift.operators import chain, injection, search

SEARCHED = {"lengths": search.window_lengths(5), "max_step": 1.0, "cadence": 0.1, "tolerance": 0.5}


@pytest.fixture(scope="module")
def data(spark):
    rnd, n = random.Random(3), 0
    lc = []
    for tic in range(12):
        for _ in range((0, 1, 4, 15, 90)[tic % 5] if tic < 10 else 300):
            # Curves over many shards of time, with equal times, values that are missing or not finite, and dips of many cadences.
            t = rnd.choice([float(rnd.randint(0, 20)), rnd.random() * 20])
            flux = rnd.choice([1.0, 1 - rnd.random() * 1e-2, 1 + rnd.random() * 1e-3, 1 - rnd.random() * 1e-4])
            lc.append((tic, 1 + tic % 2, t, None if n % 53 == 9 else float("nan") if n % 31 == 5 else flux, 0.1, n))
            n += 1
    lc.append((10, 1, None, 1.0, 0.1, n))
    tests = [(m, m % 14, 1 + m % 14 % 2, m % 2, rnd.random() * 20, 0.3, 0.01, rnd.random() * 20 if m % 3 == 0 else None, 0.5, 0.6) for m in range(90)]
    tests = spark.createDataFrame(tests, "model_idx long, tic long, sector int, inverted_lc int, inj_time double, inj_duration double, inj_depth double, "
                                         "partner_time double, partner_duration_ratio double, partner_ratio double")
    return spark.createDataFrame(lc, "tic long, sector int, time double, flux double, phase double, cadence_id long"), tests


def rows_of(df):
    return sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())


@pytest.mark.parametrize("whole", [search.WHOLE, 50, 0])
def test_whole_curves_and_shards_find_the_same(data, whole):
    lc, tests = data
    transits = injection.partner_transits(tests)
    by_shards = search.search(injection.injected_curves(lc, tests, transits, "cadence_id").select("model_idx", "time", "flux"), ["model_idx"], **SEARCHED)
    got = chain.searched_copies(lc, tests, transits, whole, **SEARCHED)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = rows_of(by_shards)
    assert len(want) > 150 and set(got.columns) == set(by_shards.columns) and rows_of(got) == want
    if whole == search.WHOLE:  # what lies above the search is narrow: no copy and no peak is shuffled
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan[:plan.index("MapInArrow")]


def test_busy_curves_go_several_ways(data):
    lc, tests = data
    transits = injection.partner_transits(tests)
    want = rows_of(injection.whole_copies(lc, tests, transits))
    assert len(want) > 2_000 and rows_of(injection.whole_copies(lc, tests, transits, together=2)) == want


def test_a_curve_in_pieces_fails_the_job(spark):
    rows = [(1, 0.1 * i, 1.0, 100_000 * i, 9) for i in range(8)]
    with pytest.raises(Exception, match="does not lie whole"):
        search.search_whole(spark.createDataFrame(rows, "model_idx long, time double, flux double, _t long, _n int"), ["model_idx"], **SEARCHED).collect()
