"""The tables that queries read, and the views that stand for chats, messages and owners in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ``conversations``: chat_id, seq, role, content; the character is chat_id mod 10, the owner mod 2."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), (F.col("conv_id") % 10).alias("character_id"), (F.col("conv_id") % 2).alias("owner_id"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ``events``: user_id is the character, event_type the model, and time is in UTC."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("character_id"), F.col("event_type").alias("model"), "value", "props")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("grp"))
