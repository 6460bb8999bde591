"""Themes: clusters of digest vectors, and what they are about over time and by character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquent.functions.values import cosine
from loquent.operators.dedupe import collapse
from loquent.operators.vectors import centroids, kmeans, nearest_centroid, nearest_each


def compute(digests: DataFrame, k: int = 30, seed: int = 1) -> DataFrame | None:
    """id, cluster and distance of every digest (id, vec, content_hash), clustered on one digest of each hash.

    None where there are no more than ``k`` vectors to cluster.
    """
    known = digests.filter(F.col("vec").isNotNull()).select("id", "vec", "content_hash")
    one_each = collapse(known, "content_hash", "id")
    if one_each.count() <= k:
        return None
    return nearest_centroid(known, kmeans(one_each, k, seed))


def similar_each(segments: DataFrame, asked: Column, limit: int = 10) -> DataFrame:
    """For each chat that ``asked`` holds for (a condition on chat_id), the ``limit`` chats of the nearest mean vectors."""
    means = centroids(segments, "chat_id")
    queries = means.filter(asked).select(F.col("chat_id").alias("query_id"), "vec")
    found = nearest_each(queries, means.select(F.col("chat_id").alias("id"), "vec"), limit)
    return found.select("query_id", "id", (1 - F.col("distance")).alias("similarity"))


def rollup(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("members"), F.avg("distance").alias("distance"))


def by_character(assigned: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests per theme and character."""
    return assigned.join(digests.select("id", "character_id"), "id").groupBy("cluster", "character_id").agg(F.count("*").alias("n"))


def similar_chats(segments: DataFrame, chat: int, limit: int = 10) -> DataFrame:
    """Chats by the cosine of their mean vectors to that of one; an unknown chat has none. segments: chat_id, vec."""
    means = centroids(segments, "chat_id").select(F.col("chat_id").alias("id"), "vec")
    own = means.filter(F.col("id") == chat).select(F.col("vec").alias("__q"))
    others = means.filter(F.col("id") != chat).crossJoin(F.broadcast(own))  # one row
    return others.select("id", cosine(F.col("vec"), F.col("__q")).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)
