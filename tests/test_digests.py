"""Digests of files on both sides of the size that is read whole."""
import hashlib

from dipsift.sources import artifacts


def test_files_of_any_size_hash_alike(spark, tmp_path):
    contents = {"empty.bin": b"", "small.bin": b"abc", "edge.bin": b"x" * 1000, "above.bin": b"x" * 1001,
                "many blocks.bin": bytes(range(256)) * 300, "exact.bin": b"y" * 2048, "twin.bin": b"y" * 2048}
    (tmp_path / "inner").mkdir()
    for i, (name, data) in enumerate(contents.items()):
        (tmp_path / ("inner" if i % 2 else "") / name).write_bytes(data)
    want = {n.replace(" ", "%20"): (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items() if d}
    for limit, block in ((1000, 512), (0, 1 << 20), (1 << 30, 7)):
        got = {r["path"].rsplit("/", 1)[1].replace(" ", "%20"): (r["n_bytes"], r["sha256"])
               for r in artifacts.path_digests(spark, str(tmp_path), "*.bin", limit, block).collect()}
        assert got == want


def test_large_files_are_listed_without_their_content(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"z" * 5000)
    plan = artifacts.path_digests(spark, str(tmp_path), "*", 10)._jdf.queryExecution().executedPlan().toString()
    # The content column belongs to the branch of small files only.
    assert plan.count("ReadSchema: struct<path:string,length:bigint,content:binary>") <= 1
    assert "MapInArrow" in plan


def test_a_changed_large_file_stops_the_gate(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"z" * 5000)
    before = spark.createDataFrame(artifacts.path_digests(spark, str(tmp_path), "*", 10, 64).collect(), artifacts.DIGEST_SCHEMA)
    (tmp_path / "a.bin").write_bytes(b"z" * 4999 + b"y")
    after = artifacts.path_digests(spark, str(tmp_path), "*", 10, 64)
    named = [d.withColumnRenamed("path", "file") for d in (after, before)]
    assert [r["problem"] for r in artifacts.digest_mismatches(*named).collect()] == ["changed"]


def test_part_files_of_equal_names_pass_the_gate(spark, tmp_path):
    """Tables that are folders hold part files of the same names."""
    for table, data in (("a.parquet", b"1"), ("b.parquet", b"2")):
        (tmp_path / table).mkdir()
        (tmp_path / table / "data_0.parquet").write_bytes(data)
    (tmp_path / "c.parquet").write_bytes(b"3")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        found = artifacts.file_digests(spark, root, "*.parquet")
        assert {r["file"] for r in found.collect()} == {"a.parquet/data_0.parquet", "b.parquet/data_0.parquet", "c.parquet"}
        recorded = spark.createDataFrame(found.collect(), found.schema)
        assert artifacts.digest_gate(spark.range(3), found, recorded).count() == 3
    (tmp_path / "a.parquet" / "data_0.parquet").write_bytes(b"2")
    changed = artifacts.digest_mismatches(artifacts.file_digests(spark, str(tmp_path), "*.parquet"), recorded).collect()
    assert [(r["file"], r["problem"]) for r in changed] == [("a.parquet/data_0.parquet", "changed")]
