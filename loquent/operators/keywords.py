"""Keywords of documents: co-occurrence and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquent.functions.text import normalize_keyword


def keyword_rows(digests: DataFrame, keywords: str = "keywords") -> DataFrame:
    """The columns of ``digests`` (digest_id, character_id, perhaps an owner) and each of its keywords once, normalised."""
    own = [c for c in digests.columns if c != keywords]
    rows = digests.select(*own, F.explode(keywords).alias("keyword"))
    return rows.select(*own, normalize_keyword(F.col("keyword")).alias("keyword")).filter(F.col("keyword").isNotNull()).distinct()


def without_hubs(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Without keywords that stand in more than ``share`` of all digests."""
    total = rows.agg(F.count_distinct("digest_id").alias("__total"))
    counts = rows.groupBy("keyword").agg(F.count("*").alias("__df"))
    hubs = counts.crossJoin(F.broadcast(total)).filter(F.col("__df") > share * F.col("__total")).select("keyword")  # total: one row
    return rows.join(hubs, "keyword", "left_anti")


def cooccurrence(rows: DataFrame, sample: int = 10, most: int = 10_000, scope: str | None = None) -> DataFrame:
    """Pairs a < b with the number of digests that have both and up to ``sample`` characters, the ``most`` frequent pairs.

    Pairs are made inside a digest's own sorted list. ``scope``: a column of ``rows``, such as the owner, that pairs are
    counted and limited in; ranks are cut before the shuffle, so a large one sends on ``most`` pairs from each task.
    """
    own = [scope] if scope else []
    lists = rows.groupBy(*own, "digest_id", "character_id").agg(F.sort_array(F.collect_set("keyword")).alias("k"))
    pairs = F.flatten(F.transform("k", lambda a, i: F.transform(F.slice("k", i + 2, F.greatest(F.size("k") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = lists.select(*own, "character_id", F.explode(pairs).alias("p")).groupBy(*own, "p.a", "p.b", "character_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*own, "a", "b").orderBy("character_id"))
    ranked = each.withColumn("__rank", rank)
    found = ranked.groupBy(*own, "a", "b").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("__rank") <= sample, F.col("character_id")))).alias("characters"))
    if not scope:
        return found.orderBy(F.desc("n"), "a", "b").limit(most)
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("n"), "a", "b"))
    return found.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def profiles(rows: DataFrame) -> DataFrame:
    return rows.groupBy("character_id", "keyword").agg(F.count("*").alias("n"))


def top_keywords(profile: DataFrame, character: int, limit: int = 25) -> DataFrame:
    return profile.filter(F.col("character_id") == character).orderBy(F.desc("n"), "keyword").limit(limit)


def with_keyword(pairs: DataFrame, seed: str, limit: int = 20) -> DataFrame:
    """What occurs with ``seed``, on either side of a pair."""
    other = F.when(F.col("a") == seed, F.col("b")).otherwise(F.col("a"))
    return pairs.filter((F.col("a") == seed) | (F.col("b") == seed)).select(other.alias("keyword"), "n").orderBy(F.desc("n"), "keyword").limit(limit)
