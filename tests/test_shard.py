"""Record shards with arrays, and records whose windows come from two sources."""
import pytest
from pyspark.sql import functions as F

from dipsift.operators import record
from dipsift.sources import artifacts

PERIOD = 3.0


@pytest.fixture(scope="module")
def native(spark):
    t = F.col("i") / 48.0
    return (spark.range(0, 48 * 60).withColumnRenamed("id", "i").select(
        F.lit(1).cast("bigint").alias("tic"), F.lit(1).cast("bigint").alias("sector"), t.alias("time"),
        (1 - F.when(F.abs((t - 1) % PERIOD) < 0.1, 0.01).otherwise(0.0) + F.sin("i") * 1e-4).alias("flux"), F.lit(1e-4).alias("flux_err"),
        ((t / PERIOD) % 1).alias("phase"), F.col("i").alias("cadence_id"))).cache()


def injected(native, depth):
    return native.withColumn("flux", F.col("flux") - F.when(F.abs(F.col("time") - 22.0) < 0.15, depth).otherwise(0.0)).withColumn("model_idx", F.lit(7))


def arrays(native, events, source):
    hosts = events.select("tic").distinct().withColumn("period", F.lit(PERIOD))
    return {r["event_id"]: (r["local"], r["recurrence"])
            for r in record.build_views(native, events, hosts, "cadence_id", source).collect()}


@pytest.fixture(scope="module")
def events(spark):
    # Event 0 is native, 1 lies in the injected copy 7, 2 names a copy that does not exist.
    return spark.createDataFrame([(1, 1, e, 22.0, (22.0 / PERIOD) % 1, 0.01, 0.3, m) for e, m in ((0, None), (1, 7), (2, 8))],
                                 "tic bigint, sector bigint, event_id bigint, event_time double, phase double, depth double, duration double, model_idx bigint")


def test_each_event_is_cut_from_its_own_curve(spark, native, events):
    alone = arrays(native, events.where("event_id = 0").drop("model_idx"), None)
    faint, deep = (arrays(native, events, injected(native, d)) for d in (0.005, 0.05))
    assert faint[0] == deep[0] == alone[0]
    assert faint[1][0] != deep[1][0] and min(deep[1][0][0]) == pytest.approx(min(faint[1][0][0]) - 0.045, abs=1e-6)
    # The injected array never reaches the stack of cycles: only the scatter normalises it.
    assert faint[1][1][1] == deep[1][1][1] == alone[0][1][1]
    assert set(deep[2][0][0]) == {0.0} and set(deep[2][0][1]) == {0.0}


def test_shard_keeps_arrays_and_describes_itself(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train" if i % 3 else "test", i % 2, [[float(i), 0.0], [1.0, 1.0]]) for i in range(20)],
                                 "event_id bigint, split string, rebalance_keep int, local array<array<float>>")
    path = str(tmp_path / "shard")
    artifacts.write_shard(rows, path)
    back = artifacts.read_shard(spark, path, kept_only=False)
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert artifacts.read_shard(spark, path, ["test"]).count() == 3
    about = artifacts.shard_attributes(spark, path).collect()
    assert [tuple(r) for r in about] == [(20, "event_id,split,rebalance_keep,local")]
    with pytest.raises(Exception, match="already exists"):
        artifacts.write_shard(rows, path)
    narrow = artifacts.read_shard(spark, path, kept_only=False).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "local" not in narrow.split("ReadSchema")[1]


def test_an_empty_shard_still_has_its_description(spark, tmp_path):
    path = str(tmp_path / "empty")
    artifacts.write_shard(spark.createDataFrame([], "event_id bigint, split string, rebalance_keep int"), path)
    assert artifacts.shard_attributes(spark, path).first()["n_events"] == 0
