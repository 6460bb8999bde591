"""The content-addressed store: once each, listed, read, verified and removed."""

import hashlib

from pyspark.sql import functions as F

from loquent.sources import assets


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_put_read_verify_and_remove(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda *xs: spark.createDataFrame([(x,) for x in xs], "content binary")
    assert assets.listed(spark, path).count() == 0
    first = {r.digest: (r.size, r.created) for r in assets.put(frame(b"one", b"two", b"one", b"", None), path).collect()}
    assert first == {digest(x): (len(x), True) for x in (b"one", b"two", b"")}
    second = {r.digest: r.created for r in assets.put(frame(b"two", b"three"), path).collect()}
    assert second == {digest(b"two"): False, digest(b"three"): True}
    held = {r.digest: (r.size, r.shard) for r in assets.listed(spark, path).collect()}
    assert held == {digest(x): (len(x), digest(x)[:2]) for x in (b"one", b"two", b"three", b"")}
    assert spark.read.parquet(path).count() == 4  # each once
    asked = spark.createDataFrame([(digest(b"two"),), (digest(b"two"),), ("ff" * 32,)], "digest string")
    for most in (10_000, 0):
        got = {r.digest: r.content and bytes(r.content) for r in assets.read(asked, path, most).collect()}
        assert got == {digest(b"two"): b"two", "ff" * 32: None}
    assert assets.verified(spark, path).filter("not ok").count() == 0
    spark.createDataFrame([(digest(b"two"), 3, b"bad")], "digest string, size bigint, content binary").write.mode("append").parquet(f"{path}/shard={digest(b'two')[:2]}")
    assert [r.digest for r in assets.verified(spark, path).filter("not ok").collect()] == [digest(b"two")]
    assets.remove(asked, path)
    assert {r.digest for r in assets.listed(spark, path).collect()} == {digest(x) for x in (b"one", b"three", b"")}
    assert assets.verified(spark, path).filter("not ok").count() == 0


def test_a_listing_reads_no_contents(spark, tmp_path):
    path = str(tmp_path / "store")
    assets.put(spark.range(20).select(F.col("id").cast("string").cast("binary").alias("content")), path)
    plan = assets.listed(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<digest:string,size:bigint>" in plan
    one = spark.createDataFrame([(digest(b"7"),)], "digest string")
    plan = assets.read(one, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and f"= {digest(b'7')[:2]})" in plan
