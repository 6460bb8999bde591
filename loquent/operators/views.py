"""What pages show: rows of several operators together, for every character or theme at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.functions.values import bucket_ms
from loquent.operators.intervals import middle_of


def themes_of(digests: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """level, cluster, members, characters and chats of each theme. digests: character_id, chat_id; levels: a cluster column each."""
    per = lambda name, c: digests.groupBy(F.lit(name).alias("level"), c.cast("bigint").alias("cluster")).agg(F.count("*").alias("members"), F.count_distinct("character_id").alias("characters"), F.count_distinct("chat_id").alias("chats"))
    return reduce(DataFrame.unionByName, [per(name, c) for name, c in levels.items()])


def top_in(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def sections(parts: dict[str, DataFrame], *keys: str) -> DataFrame:
    """Rows (keys, section, key, value) of tables that have the keys, key and value."""
    one = lambda name, df: df.select(*keys, F.lit(name).alias("section"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return reduce(DataFrame.unionByName, [one(name, df) for name, df in parts.items()])


def theme_page(digests: DataFrame, days: int = 30, most: int = 15) -> DataFrame:
    """Of every theme: members, counts per span of ``days`` days, and the ``most`` frequent characters. digests: cluster, character_id, created_at."""
    n = F.count("*").alias("value")
    characters = digests.groupBy("cluster", F.col("character_id").alias("key")).agg(n)
    return sections(
        {
            "members": digests.groupBy("cluster").agg(n).withColumn("key", F.lit("")),
            "timeline": digests.groupBy("cluster", bucket_ms(F.unix_millis("created_at"), days).alias("key")).agg(n),
            "character": top_in(characters, "cluster", [F.desc("value"), F.asc("key")], most),
        },
        "cluster",
    )


def dossiers(log: DataFrame, digests: DataFrame, keywords: DataFrame, most: int = 25) -> DataFrame:
    """Of every character: messages, first and last day, models, themes and its ``most`` frequent keywords.

    log: character_id, model, created_at; digests: character_id, cluster; keywords: character_id, keyword, n.
    """
    n, day = F.count("*").alias("value"), lambda c: F.date_format(c, "yyyy-MM-dd").alias("value")
    per = log.groupBy("character_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    alone = lambda c: per.select("character_id", F.lit("").alias("key"), c)
    words = keywords.select("character_id", F.col("keyword").alias("key"), F.col("n").alias("value"))
    return sections(
        {
            "messages": alone(F.col("n").alias("value")),
            "first_day": alone(day("first")),
            "last_day": alone(day("last")),
            "model": log.filter(F.col("model").isNotNull()).groupBy("character_id", F.col("model").alias("key")).agg(n),
            "theme": digests.groupBy("character_id", F.col("cluster").alias("key")).agg(n),
            "keyword": top_in(words, "character_id", [F.desc("value"), F.asc("key")], most),
        },
        "character_id",
    )


def distinct_models(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("model").isNotNull()).select("character_id", "model").distinct()


def suggestion_members(rows: DataFrame, known: DataFrame, least: int = 2, length: int = 2) -> DataFrame:
    """tag, id and n, the tag's items, for every item of a tag that ``known`` lacks; rows: id and tag, each pair once."""
    fresh = rows.filter(F.length("tag") >= length).join(known.select(F.lower("tag").alias("tag")).distinct(), "tag", "left_anti")
    return fresh.join(fresh.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "tag")


def running_totals(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """What ``value`` adds up to in each row, over the rows of its key so far."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("total", F.sum(value).over(so_far))


def mid_times(digests: DataFrame, messages: DataFrame) -> DataFrame:
    """The digests without a mid_at whose span has messages, with the time of the middle one of them.

    digests: chat_id, tier, block_idx, seq_start, seq_end, mid_at; messages: chat_id, seq, created_at. Running it again adds nothing.
    """
    due = digests.filter(F.col("mid_at").isNull()).drop("mid_at")
    found = middle_of(due, messages.select("chat_id", "seq", F.col("created_at").alias("mid_at")), "mid_at")
    return due.join(found, ["chat_id", "tier", "block_idx"])


def missing_hashes(rows: DataFrame, text: str, hashed: str = "content_hash") -> DataFrame:
    """The rows without a hash that have a text, with its SHA-256."""
    return rows.filter(F.col(hashed).isNull() & F.col(text).isNotNull()).withColumn(hashed, F.sha2(text, 256))


def unreferenced(assets: DataFrame, uses: list[DataFrame], key: str) -> DataFrame:
    """Assets that no table of ``uses`` (column key) names, and so may go."""
    return reduce(lambda left, use: left.join(use.select(key).filter(F.col(key).isNotNull()), key, "left_anti"), uses, assets)


def selected(messages: DataFrame, variants: DataFrame) -> DataFrame:
    """Messages (id, active) with the content of their active variant (id, idx, content); null where there is none."""
    chosen = variants.select(F.col("id").alias("__id"), "idx", "content")
    return messages.join(chosen, (F.col("id") == F.col("__id")) & (F.col("idx") == F.col("active")), "left").select("id", "active", "content")
