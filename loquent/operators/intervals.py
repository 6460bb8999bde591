"""Spans and points of a key by sweeps: starts, ends and points in one order, and totals over it.

A key of n spans and points costs n log n, and one that holds most rows is swept in ranges (``ordering``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.operators.ordering import running


def uncovered(spans: DataFrame, key: str = "chat_id", level: str = "tier", ids: tuple[str, ...] = ("chat_id", "tier", "block_idx")) -> DataFrame:
    """The spans (seq_start, seq_end) that no span of a higher level of their key holds.

    Each span asks in its own level and counts in all below. In order of starts, one that begins no later holds another
    if it ends no earlier: the largest end so far tells.
    """
    narrow = spans.select(*dict.fromkeys([key, level, "seq_start", "seq_end", *ids])).dropna(subset=[key, level, "seq_start", "seq_end"])
    levels = narrow.select(level).distinct()
    lower = levels.withColumnRenamed(level, "__level")
    asks = narrow.withColumn("__level", F.col(level)).withColumn("__end", F.lit(None).cast("long"))
    # a row a level: which there are few of
    counts = narrow.select(key, level, "seq_start", F.col("seq_end").cast("long").alias("__end")).join(F.broadcast(lower), F.col("__level") < F.col(level)).select(key, "__level", "seq_start", "__end")
    events = asks.select(*asks.columns, F.lit(1).alias("__ask")).unionByName(counts.withColumn("__ask", F.lit(0)), allowMissingColumns=True)
    swept = running(events, [key, "__level"], ["seq_start", "__ask"], F.col("__end"), "max", "__reach")
    held = swept.filter((F.col("__ask") == 1) & (F.col("__reach") >= F.col("seq_end"))).select(*ids).distinct()
    return spans.join(held, list(ids), "left_anti")


def span_of(points: DataFrame, spans: DataFrame, key: str = "chat_id", at: str = "seq", ids: tuple[str, ...] = ("block_idx",)) -> DataFrame:
    """The points with the ids of the span that holds them, for spans of a key that don't overlap; points in none go."""
    begins = spans.select(key, F.col("seq_start").alias(at), F.col("seq_start").cast("long").alias("__begin")).distinct()
    events = points.withColumn("__point", F.lit(1)).unionByName(begins.withColumn("__point", F.lit(0)), allowMissingColumns=True)
    swept = running(events.dropna(subset=[key, at]), [key], [at, "__point"], F.col("__begin"), "max", "__from")
    own = spans.select(F.col(key).alias("__key"), F.col("seq_start").cast("long").alias("__s"), "seq_end", *ids)
    met = swept.filter("__point = 1").join(own, (F.col(key) == F.col("__key")) & (F.col("__from") == F.col("__s")))
    return met.filter(F.col(at) <= F.col("seq_end")).select(*points.columns, *[own[c] for c in ids])


def middle_of(spans: DataFrame, points: DataFrame, value: str, key: str = "chat_id", at: str = "seq", ids: tuple[str, ...] = ("tier", "block_idx")) -> DataFrame:
    """key, ids and ``value`` of the middle point (the later of two) of each span that holds any; spans may overlap.

    Points are counted in order: the counts where a span starts and where it ends name its middle one.
    """
    start = spans.select(key, *ids, F.col("seq_start").alias(at), F.lit(0).alias("__kind"))
    end = spans.select(key, *ids, F.col("seq_end").alias(at), F.lit(2).alias("__kind"))
    events = points.select(key, at, value, F.lit(1).alias("__kind")).unionByName(start.unionByName(end), allowMissingColumns=True)
    swept = running(events.dropna(subset=[key, at]), [key], [at, "__kind"], (F.col("__kind") == 1).cast("long"), "sum", "__n")
    count = lambda kind: F.max(F.when(F.col("__kind") == kind, F.col("__n")))
    bounds = swept.filter("__kind <> 1").groupBy(key, *ids).agg(count(0).alias("__low"), count(2).alias("__high")).filter("__high > __low")
    middle = bounds.select(key, *ids, (F.col("__low") + F.floor((F.col("__high") - F.col("__low")) / 2) + 1).alias("__n"))
    placed = swept.filter("__kind = 1").select(F.col(key).alias("__key"), F.col("__n").alias("__at"), value)
    return middle.join(placed, (F.col(key) == F.col("__key")) & (F.col("__n") == F.col("__at"))).select(key, *ids, value)
