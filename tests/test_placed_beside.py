"""Epochs anywhere are chosen beside the times of the curve; the choice equals the one from rows."""
import random

import pytest

from dipsift.operators import chain


@pytest.fixture(scope="module")
def given(spark):
    rnd, n = random.Random(8), 0
    cad, ev = [], []
    for tic in range(9):
        for _ in range((0, 3, 40)[tic % 3]):
            cad.append((tic, 1, rnd.choice([float(rnd.randint(0, 12)), rnd.random() * 12]), n))
            n += 1
        for i in range(tic % 5):
            ev.append((tic, 1, i, None if i == 2 else float(rnd.randint(0, 12)), rnd.choice([None, 0.0, 0.7, 3.0])))
    cad = spark.createDataFrame(cad, "tic long, sector int, time double, n long")
    events = spark.createDataFrame(ev, "tic long, sector int, event_id long, event_time double, duration double")
    tests = spark.createDataFrame([(m, m % 10, 1, m // 10 % 2, rnd.choice([0.0, 0.4, 2.0])) for m in range(200)], "model_idx long, tic long, sector int, inverted_lc int, inj_duration double")
    return chain.Source(cad, cad.select("tic", "sector", "time"), events, None), tests


def found(given, **limits):
    source, tests = given
    rows, blocked = chain.placed(tests, source, chain.anywhere("e"), **limits)
    return {r.model_idx: r.inj_time for r in rows.collect()}, {r.model_idx: r.n_blocked for r in blocked.collect() if r.n_blocked}


@pytest.mark.parametrize("limits", [{}, {"meetings": 60}, {"whole": 10}])
def test_choice_beside_the_times_equals_the_one_from_rows(given, limits):
    epochs, blocked = found(given, whole=0)  # all free cadences as rows
    assert len(epochs) > 90 and len(set(blocked.values())) >= 4
    assert found(given, **limits) == (epochs, blocked)


def test_no_copies_are_made_where_any_cadence_will_do(given, monkeypatch):
    monkeypatch.setattr(chain, "free_cadences", None)
    source, tests = given
    rows, _ = chain.placed(tests, source, chain.anywhere("e"))
    assert rows.count() > 90
