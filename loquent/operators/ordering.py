"""Numbers and running totals inside keys, of which one may hold most rows: no task sorts a whole key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.sources.scratch import written


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, written in ranges of (keys, order), with ``__range``: a large key spans several of them."""
    laid = rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    return written(laid)


def _before(held: DataFrame, keys: Sequence[str], made: Column, over: Callable[[str], Column], none: Column) -> DataFrame:
    """For each range of a key that isn't its first, what the ranges before it come to: a row a range and key at most."""
    per = held.groupBy(*keys, "__range").agg(made.alias("__v"))
    several = per.groupBy(*keys).agg(F.count("*").alias("__c")).filter("__c > 1").drop("__c")
    so_far = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    return per.join(several, list(keys)).select(*keys, "__range", F.coalesce(over("__v").over(so_far), none).alias("__before"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "nth") -> DataFrame:
    """Adds the place (from 0) of each row in its key; ``order`` has to be total for it to be fixed. Keys aren't null."""
    held = ranged(rows, keys, order)
    before = _before(held, keys, F.count("*"), F.sum, F.lit(0))
    within = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)) - 1
    both = held.withColumn("__w", within).join(before, [*keys, "__range"], "left")
    return both.select(*rows.columns, (F.col("__w") + F.coalesce("__before", F.lit(0))).alias(name))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, how: str = "sum", name: str = "total") -> DataFrame:
    """Adds the sum or the maximum (``how``) of ``value`` over the rows of the key up to this one, ties in ``order`` by row."""
    over = {"sum": F.sum, "max": F.max}[how]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}[how]
    held = ranged(rows.withColumn("__x", value), keys, order)
    before = _before(held, keys, over("__x"), over, F.lit(None))
    within = over("__x").over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = held.withColumn("__w", within).join(before, [*keys, "__range"], "left")
    return both.select(*rows.columns, join(F.col("__w"), F.col("__before")).alias(name))
