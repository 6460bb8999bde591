"""What the operators of this subpackage share: scratch tables, size-checked joins, running totals."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.sources.scratch import folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side that was counted may be broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of the batches that go to Python, where the session doesn't say: a task holds several, in Java and in Python.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared scratch folder and reads it back: its lineage ends there.

    A lost executor costs no more than a read of these files, and Spark knows the size of what it reads. Where the
    session has no size of batches for Python, it gets ``BATCH_BYTES``, so that long texts don't fill a task.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(BATCH_BYTES[0], str(BATCH_BYTES[1]))
    path = f"{folder(spark)}/loquent-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None, compression="zstd")
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these tables, once all that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that nothing refers to any more, before a stage that needs much disk."""
    spark.range(1).count()  # else the last query is still referred to
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_small(df: DataFrame, small: DataFrame, on: str, rows: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """Joins ``small``, which has ``rows`` rows and each key once, to ``df``, whose keys may be hot.

    Up to ``BROADCAST_ROWS`` rows it is broadcast. Beyond that each of its rows is repeated for ``salts`` salts
    and the rows of ``df`` are dealt over them, so that a hot key is shared by that many tasks; the join is merged, as
    Spark sizes the repeated rows as if they were there once and would broadcast them. Null keys match null keys.
    """
    if rows <= BROADCAST_ROWS:
        right = F.broadcast(small.withColumnRenamed(on, "__key"))
        return df.join(right, df[on].eqNullSafe(right["__key"]), how).drop("__key")
    many = small.withColumnRenamed(on, "__key").withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    left = df.withColumn("__salt", F.pmod(F.xxhash64(*[df[c] for c in df.columns if c != on]), F.lit(salts)).cast("int"))
    cond = left["__salt"].eqNullSafe(many["__salt_r"]) & left[on].eqNullSafe(many["__key"])
    return left.join(many, cond, how).drop("__salt", "__salt_r", "__key")


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row, for each name in ``sums``, the total of that column over all rows before it in ``order``.

    No task sees all rows: rows are dealt into ranges, ranges are summed, and the few range totals carry over.
    ``order`` must be total for the result to be fixed.
    """
    held = df.select("*", *[c.alias(f"__v_{k}") for k, c in sums.items()])
    ranged = materialize(held.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(totals), "__range")  # one row a range
    return out.select(*df.columns, *[(F.col(f"__b_{k}") + F.coalesce(F.sum(f"__v_{k}").over(within), F.lit(0))).alias(k) for k in sums])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a function makes of one batch stays small; freed memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Of rows sorted by ``keys``, each run of equal keys as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy() for k in keys]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if not len(edge):
            continue
        for begin, end in zip([0, *edge[:-1].tolist()], edge.tolist()):
            yield table.slice(begin, end - begin)
        held = table.slice(int(edge[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(docs: DataFrame, gone: DataFrame, on: str = "doc_id") -> DataFrame:
    """``docs`` but for the ids in ``gone``, which is broadcast up to ``BROADCAST_ROWS`` rows; null ids stay."""
    gone = materialize(gone.select(on).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")
