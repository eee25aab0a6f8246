"""Shards whose wide arrays are written once."""

from pyspark.sql import functions as F

from dipsift.sources import artifacts


def test_shard_rows_are_finished_as_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train", 1, i) for i in range(6)], "event_id bigint, split string, rebalance_keep int, v bigint")
    path = str(tmp_path / "shard")
    artifacts.write_shard(rows, path, finish=lambda df: df.withColumn("v", F.array_repeat(F.col("v"), 3)))
    assert {tuple(r["v"]) for r in artifacts.read_shard(spark, path).collect()} == {(i,) * 3 for i in range(6)}
    assert artifacts.shard_attributes(spark, path).first()["n_events"] == 6
