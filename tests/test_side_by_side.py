"""Cover by one running total, and ranges of a campaign that run side by side."""
import random
from threading import Barrier, BrokenBarrierError

import pytest
from pyspark.sql import functions as F

from dipsift.operators import chain, pairs


@pytest.mark.parametrize("closed", [False, True])
def test_cover_is_one_running_total(spark, closed):
    rnd = random.Random(5)
    points = [(k, i, rnd.choice([float(rnd.randint(0, 40)), rnd.random() * 40])) for k in range(5) for i in range(60)]
    spans = [(k, None if rnd.random() < 0.1 else a, a + rnd.choice([-1.0, 0.0, 1.0, 9.0])) for k in range(4) for a in [float(rnd.randint(0, 40)) for _ in range(12)]]
    got = pairs.covered(spark.createDataFrame(points, "tic long, id long, t double"), spark.createDataFrame(spans, "tic long, a double, z double"),
                        ["tic"], "t", "a", "z", closed)
    assert got.columns == ["tic", "id", "t", "covered"]

    def held(k, t):
        mine = [(a, z) for tic, a, z in spans if tic == k]
        begun = sum(a is not None and (a <= t if closed else a < t) for a, _ in mine)
        return int(begun > sum(z < t if closed else z <= t for _, z in mine))
    assert sorted((r.tic, r.id, r.covered) for r in got.collect()) == sorted((k, i, held(k, t)) for k, i, t in points)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2  # one in the shards, one across them


def test_ranges_run_side_by_side_and_a_lost_one_is_not_entered(spark, tmp_path):
    tests = spark.range(40).select(F.col("id").alias("model_idx"))
    bounds, both = [(0, 20), (20, 40)], Barrier(2)

    def run(part):
        both.wait(timeout=60)  # breaks unless both are under way
        return part
    assert sorted(r.model_idx for r in chain.run_ranges(tests, bounds, str(tmp_path / "a"), run, together=2).collect()) == list(range(40))
    assert sorted(chain.finished(spark, str(tmp_path / "a"))) == bounds

    def lose(part):
        if part.agg(F.min("model_idx")).first()[0] == 0:
            raise BrokenBarrierError("lost")
        return part
    with pytest.raises(BrokenBarrierError):
        chain.run_ranges(tests, bounds, str(tmp_path / "b"), lose, together=2)
    assert (0, 20) not in chain.finished(spark, str(tmp_path / "b"))
    assert chain.run_ranges(tests, bounds, str(tmp_path / "b"), lambda part: part, together=2).count() == 40
