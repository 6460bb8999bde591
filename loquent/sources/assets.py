"""A content-addressed store: binary contents under their SHA-256, in Parquet folders by its first two digits.

Each put is one job whose output is committed whole, so tasks that run again leave nothing behind.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.sources.scratch import written

_SCHEMA = "digest string, size bigint, content binary, shard string"


def _table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def put(contents: DataFrame, path: str, column: str = "content") -> DataFrame:
    """Stores each content that isn't there yet, once, and returns digest, size and ``created`` of every different one.

    Copies in ``contents`` are combined before contents move; null ones don't count. What is there is looked up by its
    digest alone. Two puts at the same time may both write a content; readers see it once.
    """
    spark = contents.sparkSession
    rows = contents.filter(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("digest"), F.octet_length(column).cast("long").alias("size"), F.col(column).cast("binary").alias("content"))
    held = listed(spark, path).select("digest", F.lit(True).alias("__there"))
    asked = written(rows.select("digest", "size").distinct().join(held, "digest", "left").select("digest", "size", F.col("__there").isNull().alias("created")))
    new = rows.join(asked.filter("created").select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("size").alias("size"), F.first("content").alias("content"))
    new.withColumn("shard", F.left("digest", F.lit(2))).hint("rebalance", "shard").write.partitionBy("shard").mode("append").parquet(path, compression="zstd")
    return asked


def listed(spark: SparkSession, path: str) -> DataFrame:
    """digest, size and shard of all that is stored; contents aren't read."""
    return _table(spark, path).groupBy("digest", "shard").agg(F.max("size").alias("size")).select("digest", "size", "shard")


def read(digests: DataFrame, path: str, most: int = 10_000) -> DataFrame:
    """digest and content of the asked ones (column digest); null where nothing is stored. Few asked ones narrow the scan to their shards."""
    asked = written(digests.select("digest").distinct())
    table = _table(digests.sparkSession, path)
    if asked.count() <= most:
        shards = [r["s"] for r in asked.select(F.left("digest", F.lit(2)).alias("s")).distinct().collect()]
        table = table.filter(F.col("shard").isin(shards))
    found = table.join(asked, "digest", "left_semi").groupBy("digest").agg(F.first("content").alias("content"))
    return asked.join(found, "digest", "left")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """digest, shard and whether what is stored under it is its content."""
    rows = _table(spark, path)
    fits = (F.sha2("content", 256) == F.col("digest")) & (F.left("digest", F.lit(2)) == F.col("shard"))
    return rows.groupBy("digest", "shard").agg(F.min(F.coalesce(fits, F.lit(False))).alias("ok"))


def remove(digests: DataFrame, path: str) -> None:
    """Takes the asked ones out; only their shards are written anew."""
    spark = digests.sparkSession
    asked = written(digests.select("digest").distinct())
    shards = [r["s"] for r in asked.select(F.left("digest", F.lit(2)).alias("s")).distinct().collect()]  # 256 at most
    left = written(_table(spark, path).filter(F.col("shard").isin(shards)).join(asked, "digest", "left_anti"))
    kept = [r["shard"] for r in left.select("shard").distinct().collect()]
    if kept:
        left.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path, compression="zstd")
    for shard in set(shards) - set(kept):  # nothing is left of it
        spark.createDataFrame([], "digest string, size bigint, content binary").write.mode("overwrite").parquet(f"{path}/shard={shard}")
