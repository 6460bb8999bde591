"""Avatars: what looks alike, searches over image vectors, and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquent.operators.vectors import kmeans, nearest_centroid, nearest_each
from loquent.sources.scratch import written


def avatars(images: DataFrame, versions: DataFrame) -> DataFrame:
    """character_id, asset_id and vec of each character whose avatar has a vector. images: id, vec; versions: character_id, asset_id."""
    return versions.join(images.select(F.col("id").alias("asset_id"), "vec").filter(F.col("vec").isNotNull()), "asset_id").select("character_id", "asset_id", "vec")


def image_search(images: DataFrame, versions: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest images of each query, with each character that has one as its avatar; a row without one if none has."""
    found = nearest_each(queries, images, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).join(versions.withColumnRenamed("asset_id", "id"), "id", "left").select("query_id", "rank", "id", "distance", "character_id")


def similar_art(held: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """For each character of ``asked`` (character_id) the ``k`` others whose avatars are nearest. held: ``avatars``.

    Images are compared once, however many characters have them, and of each only the ``k`` + 1 characters of least id
    meet others, of whom one may be the asker. An image goes by the least character that has it, so where distances are
    equal the k nearest images and the character's own hold the k nearest characters.
    """
    first = held.groupBy("asset_id").agg(F.min("character_id").alias("id"))
    images = held.join(first, (held["asset_id"] == first["asset_id"]) & (held["character_id"] == first["id"])).select("id", "vec").dropDuplicates(["id"])
    queries = held.select("character_id", "asset_id").join(asked, "character_id", "left_semi").join(first, "asset_id").select(F.col("character_id").alias("query_id"), F.col("id").alias("own"))
    wanted = images.join(queries.select(F.col("own").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "vec")
    near = nearest_each(wanted, images, k).select(F.col("query_id").alias("own"), "id", "distance")
    near = near.unionByName(wanted.select(F.col("query_id").alias("own"), F.col("query_id").alias("id"), F.lit(0.0).alias("distance")))
    nth = F.row_number().over(Window.partitionBy("asset_id").orderBy("character_id"))
    few = held.select("character_id", "asset_id").withColumn("nth", nth).filter(F.col("nth") <= k + 1).join(first, "asset_id").select("id", "character_id")
    place = F.row_number().over(Window.partitionBy("own").orderBy("distance", "character_id"))
    lists = near.join(few, "id").withColumn("place", place).filter(F.col("place") <= k + 1)
    pairs = queries.join(lists, "own").filter(F.col("character_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "character_id", (1 - F.col("distance")).alias("similarity"))


def visual_archetypes(held: DataFrame, facets: DataFrame, k: int = 8, seed: int = 1) -> DataFrame | None:
    """Styles of avatars: size, most common genre and tone, a label of both, and the first twelve characters.

    facets: character_id, genre, tone. None where there are no more than ``k`` avatars. Clusters are made of images, each
    with the weight of the characters that have it.
    """
    if held.count() <= k:
        return None
    had = held.groupBy("asset_id").agg(F.count("*").alias("n"), F.min("character_id").alias("character_id"))
    rows = written(held.join(had, ["asset_id", "character_id"]).select(F.col("asset_id").alias("id"), "vec", "n").dropDuplicates(["id"]))
    places = nearest_centroid(rows, kmeans(rows, k, seed, weight="n")).select(F.col("id").alias("asset_id"), "cluster")
    assigned = held.select("character_id", "asset_id").join(places, "asset_id").select("character_id", "cluster")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("character_id"))
    first = assigned.withColumn("nth", rank).filter(F.col("nth") <= 12).groupBy("cluster").agg(F.sort_array(F.collect_list("character_id")).alias("members"))
    mode = lambda c: F.mode(F.when(F.col(c) != "", F.col(c)), True).alias(c)
    sizes = assigned.join(facets, "character_id", "left").groupBy("cluster").agg(F.count("*").alias("size"), mode("genre"), mode("tone"))
    label = F.concat_ws(" ", "tone", "genre")
    return sizes.join(first, "cluster").withColumn("label", F.when(label == "", "mixed").otherwise(label)).orderBy(F.desc("size"), "cluster")
