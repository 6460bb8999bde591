"""Corpus statistics over chats, messages and an activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.functions.text import snippet
from loquent.functions.values import bucket_ms


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the count of each table, from one-row aggregates."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def counts_by(df: DataFrame, key: Column | str, name: str = "messages") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def by_day(log: DataFrame, at: str = "created_at") -> DataFrame:
    return counts_by(log, F.date_format(at, "yyyy-MM-dd").alias("day"))


def by_hour(log: DataFrame, at: str = "created_at") -> DataFrame:
    return counts_by(log, F.hour(at).alias("hour"))


def by_model(log: DataFrame, model: str = "model") -> DataFrame:
    """Messages per model; null is its own group, named (unknown)."""
    return counts_by(log, model).withColumn(model, F.coalesce(model, F.lit("(unknown)")))


def top_characters(chats: DataFrame, messages: DataFrame, limit: int = 20) -> DataFrame:
    """Characters by chats, then messages; chats without messages count. chats: chat_id, character_id."""
    per_chat = messages.groupBy("chat_id").agg(F.count("*").alias("n"))
    joined = chats.join(per_chat, "chat_id", "left")
    per = joined.groupBy("character_id").agg(F.count_distinct("chat_id").alias("chats"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
    return per.orderBy(F.desc("chats"), F.desc("messages"), "character_id").limit(limit)


def character_profiles(messages: DataFrame) -> DataFrame:
    """Per character: chats, messages by role, first and last seq."""
    return messages.groupBy("character_id").agg(
        F.count_distinct("chat_id").alias("chats"),
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.sum(F.length("content")).alias("chars"),
        F.max("seq").alias("last_seq"),
    )


def forgotten(log: DataFrame, least: int = 30, limit: int = 20) -> DataFrame:
    """Characters with ``least`` messages or more, longest unseen first."""
    per = log.groupBy("character_id").agg(F.count("*").alias("messages"), F.max("created_at").alias("last_active"))
    return per.filter(F.col("messages") >= least).orderBy(F.asc_nulls_first("last_active"), "character_id").limit(limit)


def routing(log: DataFrame, group: str = "grp", model: str = "model", top: int = 5) -> DataFrame:
    """Per group its ``top`` models with their share of the whole group; ``top_sum`` orders groups by those models alone."""
    counts = log.groupBy(group, model).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("n"), model)))
    return ranked.filter(F.col("rank") <= top).withColumn("top_sum", F.sum("n").over(whole))


def drift(log: DataFrame, theme: str, fmt: str = "yyyy-MM", at: str = "created_at", top: int = 6) -> DataFrame:
    """Per month its ``top`` themes."""
    counts = log.groupBy(F.date_format(at, fmt).alias("period"), theme).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), theme))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def timeline(log: DataFrame, days: int = 7, at: str = "created_at") -> DataFrame:
    """Counts per span of ``days`` days from 1970 on."""
    return counts_by(log, bucket_ms(F.unix_millis(at), days).alias("bucket"), "n")


def swipe_totals(variants: DataFrame) -> DataFrame:
    """variants: message_id per variant. The average is 0 without messages."""
    one = variants.agg(F.count("*").alias("variants"), F.count_distinct("message_id").alias("messages"))
    return one.withColumn("average", F.coalesce(F.try_divide("variants", "messages"), F.lit(0.0)))


def swipe_hotspots(variants: DataFrame, limit: int = 15) -> DataFrame:
    per = variants.groupBy("message_id").agg(F.count("*").alias("variants"))
    return per.orderBy(F.desc("variants"), "message_id").limit(limit)


def hotspot_texts(hotspots: DataFrame, messages: DataFrame) -> DataFrame:
    """Hotspots with the beginning of their messages (message_id, content); one whose message is gone has none."""
    return hotspots.join(messages.select("message_id", snippet(F.col("content")).alias("snippet")), "message_id", "left")


def swipes_by(variants: DataFrame, key: str, least_messages: int = 5, limit: int = 20) -> DataFrame:
    per = variants.groupBy(key).agg(F.count("*").alias("variants"), F.count_distinct("message_id").alias("messages"))
    per = per.filter(F.col("messages") >= least_messages).withColumn("average", F.col("variants") / F.col("messages"))
    return per.orderBy(F.desc("average"), key).limit(limit)


def rate_audit(log: DataFrame, limit: int, seconds: int = 60, key: str = "character_id", at: str = "created_at") -> DataFrame:
    """Windows in which a key has more than ``limit`` entries."""
    per = log.groupBy(key, F.window(at, f"{seconds} seconds").start.alias("start")).agg(F.count("*").alias("n"))
    return per.filter(F.col("n") > limit)


def log_tail(log: DataFrame, contains: str | None = None, level: str | None = None, newest: int = 2000, limit: int | None = 100) -> DataFrame:
    """Of the ``newest`` entries those with a substring and a model, newest first: ``limit``, 2000 at most, 100 if it isn't above 0."""
    limit = min(limit, 2000) if limit and limit > 0 else 100
    tail = log.orderBy(F.desc("event_id")).limit(newest)
    if contains:
        tail = tail.filter(F.col("props").contains(contains))
    if level:
        tail = tail.filter(F.col("model") == level)
    return tail.orderBy(F.desc("event_id")).limit(limit)
