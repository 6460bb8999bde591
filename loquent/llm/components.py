"""Connected components by contraction: each node joins its least neighbour, and what joined becomes one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import discard, materialize


def trees(links: DataFrame) -> DataFrame:
    """``node`` and ``up``, the root of its tree, where each node of ``links`` (a, b) hangs on its least neighbour.

    Of two nodes that name each other the lesser is the root; no longer cycle can be. Pointers double until none changes.
    """
    both = links.union(links.select("b", "a"))
    held = materialize(both.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "node"))
    while True:
        above = held.select(F.col("node").alias("__n"), F.col("up").alias("__up"))
        up = F.when(F.col("__up") == F.col("node"), F.least("node", "up")).otherwise(F.col("__up"))
        new = materialize(held.select("node", "up").join(above, F.col("up") == F.col("__n")).select("node", F.col("up").alias("old"), up.alias("up")))
        discard(held)
        held = new
        if not new.filter("old <> up").limit(1).count():
            return new


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of ``edges`` (columns a, b).

    Every tree has two nodes at least, so a round halves the nodes that still have links, and rounds are at most the
    logarithm of the nodes, whatever their ids. Tables are written between rounds; only a test for links left and
    changes reaches the driver.
    """
    pairs = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    links = materialize(edges.select(*pairs("a", "b")).filter("a <> b").distinct())
    named = links.select(F.col("a").alias("node"), F.col("a").alias("root"))  # holds where there are no links
    first = True
    while links.limit(1).count():
        held = trees(links)
        up = lambda side: held.select(F.col("node").alias(side), F.col("up").alias(f"__{side}"))  # noqa: E731, B023
        if first:
            new = materialize(held.select("node", F.col("up").alias("root")))
        else:
            new = materialize(named.join(up("root"), "root", "left").select("node", F.coalesce("__root", "root").alias("root")))
            discard(named)
        named, first = new, False
        left = materialize(links.join(up("a"), "a").join(up("b"), "b").select(*pairs("__a", "__b")).filter("a <> b").distinct())
        discard(links, held)
        links = left
    if not first:
        discard(links)
    least = named.groupBy("root").agg(F.min("node").alias("label"))
    return named.join(least, "root").select("node", "label")
