"""Resamples by blocks against the same draws in plain Python."""
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from dipsift.operators import evaluate


def u(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2 ** 52


@pytest.mark.parametrize("n, members, draws", [(1, 4, 8), (23, 4, 5), (23, 256, 1 << 16), (64, 8, 64)])
def test_resamples_equal_brute_force(spark, n, members, draws):
    values = [(f"t{i:03d}", i * i % 17, 1) for i in range(n)]
    per = spark.createDataFrame(values, "tic string, a long, one long").repartition(3)
    got = {r["b"]: (r["a"], r["one"]) for r in evaluate.resampled(per, "tic", ["a", "one"], 40, "s", members, draws).collect()}
    want = {}
    for b in range(40):
        fallen = {}
        for slot in range(n):
            block = math.floor(u(b, slot, "s") * n) // members
            fallen[block] = fallen.get(block, 0) + 1
        total = 0
        for block, c in fallen.items():
            size = min(members, n - block * members)
            total += sum(values[block * members + math.floor(u(b, block, j, "s.in") * size)][1] for j in range(c))
        want[b] = (total, n)
    assert got == want


def test_resamples_spread_as_draws_with_replacement_do(spark):
    """Mean and variance of one row's count over resamples are those of a binomial of n draws at 1 / n."""
    n, times = 300, 3000
    per = spark.range(n).select(F.format_string("t%04d", "id").alias("tic"), *[(F.col("id") == k).cast("long").alias(f"c{k}") for k in (0, 150, 299)])
    sums = evaluate.resampled(per, "tic", ["c0", "c150", "c299"], times, "s", members=16)
    row = sums.agg(*[f(c).alias(f"{name}_{c}") for c in ("c0", "c150", "c299") for name, f in (("mean", F.avg), ("var", F.variance))],
                   F.corr("c0", "c150").alias("corr")).first()
    for c in ("c0", "c150", "c299"):
        assert abs(row[f"mean_{c}"] - 1) < 0.1 and abs(row[f"var_{c}"] - (1 - 1 / n)) < 0.15
    assert abs(row["corr"]) < 0.1


def test_resamples_of_an_empty_table(spark):
    per = spark.createDataFrame([], "tic string, a long")
    assert evaluate.resampled(per, "tic", ["a"], 10, "s").count() == 0
