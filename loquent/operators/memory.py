"""Blocks of chats, their digests over several tiers, and what a new turn recalls of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.functions.text import trimmed
from loquent.functions.values import cosine
from loquent.operators.intervals import span_of, uncovered
from loquent.operators.ordering import running


@dataclass(frozen=True)
class MemoryConfig:
    block_size: int = 8
    verbatim: int = 8
    query_window: int = 2
    mode: str = "mixC"
    fan_out: int = 4
    max_tier: int = 3
    retrieve_k: int = 8
    rerank_to: int = 5
    min_score: float = 0.25
    keyword_match: bool = True
    recency_bias: float = 0.0


def history(messages: DataFrame) -> DataFrame:
    """Messages with content, but for those of the system."""
    return messages.filter((F.col("role") != "system") & (trimmed(F.col("content")) != ""))


def blocks(messages: DataFrame, size: int = 8, char: str = "Character", user: str = "User", partial: bool = True, aged: int | None = None) -> DataFrame:
    """Consecutive blocks of ``size`` messages of a chat: span, transcript and its SHA-256.

    ``aged``: only messages that many seqs before the chat's last; ``partial``: with the last, shorter block. Messages
    are numbered in ranges of (chat, seq), without their texts, so no task sorts a whole chat; a seq is a message.
    """
    rows = history(messages)
    places = rows.groupBy("chat_id", "seq").agg(F.count("*").alias("__c"))
    if aged is not None:
        last = rows.groupBy("chat_id").agg(F.max("seq").alias("__last"))
        places = places.join(last, "chat_id").filter(F.col("seq") <= F.col("__last") - aged).drop("__last")
    numbered = running(places, ["chat_id"], ["seq"], F.col("__c"), "sum", "__total")
    nth = F.col("__total") - F.col("__c")
    rows = rows.join(numbered.select("chat_id", "seq", F.floor(nth / size).cast("int").alias("block_idx")), ["chat_id", "seq"])
    line = F.concat(F.when(F.col("role") == "user", user).otherwise(char), F.lit(": "), trimmed(F.col("content")))
    made = rows.groupBy("chat_id", "block_idx").agg(F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    made = made.withColumn("text", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"))
    if not partial:
        made = made.filter(F.col("n") == size)
    middle = F.get(F.transform("lines", lambda x: x["seq"]), F.floor(F.col("n") / 2).cast("int"))
    return made.select("chat_id", "block_idx", "seq_start", "seq_end", "n", middle.alias("seq_mid"), "text", F.sha2("text", 256).alias("content_hash"))


def stale(fresh: DataFrame, stored: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Blocks to build again: missing, with another span, or edited after they were stored.

    stored: chat_id, block_idx, seq_start, seq_end, created_at; edits: chat_id, seq, edited_at.
    """
    old = stored.select("chat_id", "block_idx", F.col("seq_start").alias("__s"), F.col("seq_end").alias("__e"), F.col("created_at").alias("__at"))
    both = fresh.join(old, ["chat_id", "block_idx"], "left")
    due = F.col("__at").isNull() | (F.col("seq_start") != F.col("__s")) | (F.col("seq_end") != F.col("__e"))
    if edits is not None:
        last = span_of(edits.select("chat_id", "seq", "edited_at"), fresh).groupBy("chat_id", "block_idx").agg(F.max("edited_at").alias("__edited"))
        both = both.join(last, ["chat_id", "block_idx"], "left")
        due = due | F.coalesce(F.col("__edited") > F.col("__at"), F.lit(False))
    return both.filter(due).select(fresh.columns)


def refreshed(fresh: DataFrame, stored: DataFrame, built: DataFrame) -> DataFrame:
    """The new state of a block table: stored blocks that are still there and not built again, and the built ones."""
    keys = ["chat_id", "block_idx"]
    kept = stored.join(fresh.select(keys), keys, "left_semi").join(built.select(keys), keys, "left_anti")
    return kept.unionByName(built.select(stored.columns))


def consolidate(tier: DataFrame, level: int, fan_out: int = 4, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Digests of the next tier: ``fan_out`` whole children each. tier: chat_id, block_idx, seq_start, seq_end, text."""
    parts = tier.withColumn("__up", F.floor(F.col("block_idx") / fan_out).cast("int"))
    made = parts.groupBy("chat_id", "__up").agg(F.count("*").alias("__n"), F.min("seq_start").alias("seq_start"), F.max("seq_end").alias("seq_end"), F.sort_array(F.collect_list(F.struct("block_idx", "text"))).alias("__c"))
    text = F.array_join(F.transform("__c", lambda x: x["text"]), "\n\n")
    made = made.filter(F.col("__n") == fan_out)
    return made.select("chat_id", F.lit(level).alias("tier"), F.col("__up").alias("block_idx"), "seq_start", "seq_end", (summarise(text) if summarise else text).alias("text"))


def digests(messages: DataFrame, cfg: MemoryConfig = MemoryConfig(), summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Digests of all tiers of aged messages; without a summariser the texts themselves."""
    base = blocks(messages, cfg.block_size, partial=False, aged=cfg.verbatim)
    tier = base.select("chat_id", F.lit(0).alias("tier"), "block_idx", "seq_start", "seq_end", (summarise(F.col("text")) if summarise else F.col("text")).alias("text"))
    out = tier
    for level in range(1, cfg.max_tier + 1):
        tier = consolidate(tier, level, cfg.fan_out, summarise)
        out = out.unionByName(tier)
    return out


def bridge(tiers: DataFrame) -> DataFrame:
    """Digests whose span no higher tier holds: coarse for old parts, fine for new ones."""
    return uncovered(tiers)


def recent_query(messages: DataFrame, window: int = 2) -> DataFrame:
    """Per chat its last ``window`` messages with content, in order, a line each."""
    nth = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("seq")))
    last = history(messages).withColumn("__nth", nth).filter(F.col("__nth") <= window)
    return last.groupBy("chat_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("query"))


def last_by_role(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(
        F.max_by("content", "seq").alias("last_message"),
        F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("seq"))).alias("last_user"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("content")), F.when(F.col("role") == "assistant", F.col("seq"))).alias("last_assistant"),
    )


def fork(messages: DataFrame, chat: int, new_chat: int, at_seq: int, accounted: tuple[str, ...] = ()) -> DataFrame:
    """The messages of a chat up to a seq as a new chat; columns in ``accounted`` are null, so that nothing counts twice."""
    copied = messages.filter((F.col("chat_id") == chat) & (F.col("seq") <= at_seq)).withColumn("chat_id", F.lit(new_chat).cast(dict(messages.dtypes)["chat_id"]))
    return copied.withColumns({c: F.lit(None).cast(dict(messages.dtypes)[c]) for c in accounted})


def recall(tiers: DataFrame, query_text: str, query_vector: Column, cfg: MemoryConfig = MemoryConfig(), scorer: Callable[[str, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Digests recalled for one chat's scene, in order of time. tiers: with vec (may be null) and keywords (array)."""
    if cfg.mode == "off":
        return tiers.limit(0)
    if cfg.mode == "mixA":
        return tiers.filter("tier = 0").orderBy("seq_start")
    pool = bridge(tiers)
    if cfg.mode == "tiered" or not query_text:
        return pool.orderBy("seq_start")
    recency = cfg.recency_bias * F.col("seq_start") / F.greatest(F.max("seq_start").over(Window.partitionBy("chat_id")), F.lit(1))
    near = F.when(F.col("vec").isNotNull(), cosine(F.col("vec"), query_vector))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = F.array_distinct(words(F.lit(query_text)))
    telling = F.filter(F.flatten(F.transform("keywords", words)), lambda w: (F.length(w) >= 4) | w.rlike(r"[^\x00-\x7F]"))
    hit = F.coalesce(F.arrays_overlap(telling, known), F.lit(False)) & F.lit(cfg.keyword_match)
    score = F.when(near >= cfg.min_score, near + recency).when(hit, cfg.min_score + recency)
    chosen = pool.withColumn("score", score).filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "tier", "block_idx").limit(cfg.retrieve_k)
    if cfg.mode == "mixC" and scorer:
        from loquent.operators.search import rerank

        ranked = rerank(chosen.withColumnRenamed("score", "first_score"), query_text, "text", scorer)
        chosen = ranked.orderBy(F.desc("score"), F.desc("first_score"), "tier", "block_idx").limit(cfg.rerank_to)
    return chosen.orderBy("seq_start")


def recall_each(tiers: DataFrame, asked: DataFrame, cfg: MemoryConfig = MemoryConfig(), scorer: Callable[[str, pd.Series], pd.Series] | None = None) -> DataFrame:
    """``recall`` for a table of chats: what each recalls of its own digests, with ``score`` and ``place`` in order of time.

    tiers: chat_id, tier, block_idx, seq_start, seq_end, text, vec (may be null), keywords; asked: chat_id, query_text and
    vec, a row a chat. A digest meets the one query of its chat; ranks are cut before the shuffle, so a chat of very many
    digests sends on ``retrieve_k`` from each task.
    """
    mine = tiers.join(asked.select("chat_id").distinct(), "chat_id", "left_semi")
    if cfg.mode == "off":
        return _placed(mine.limit(0).withColumn("score", F.lit(None).cast("double")))
    if cfg.mode == "mixA":
        return _placed(mine.filter("tier = 0").withColumn("score", F.lit(None).cast("double")))
    pool = bridge(mine)
    if cfg.mode == "tiered":
        return _placed(pool.withColumn("score", F.lit(None).cast("double")))
    top = pool.groupBy("chat_id").agg(F.max("seq_start").alias("__top"))
    query = asked.select("chat_id", F.coalesce("query_text", F.lit("")).alias("query_text"), F.col("vec").alias("__vec"))
    both = pool.join(query, "chat_id").join(top, "chat_id")
    recency = cfg.recency_bias * F.col("seq_start") / F.greatest("__top", F.lit(1))
    near = F.when(F.col("vec").isNotNull() & F.col("__vec").isNotNull(), cosine(F.col("vec"), F.col("__vec")))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    telling = F.filter(F.flatten(F.transform("keywords", words)), lambda w: (F.length(w) >= 4) | w.rlike(r"[^\x00-\x7F]"))
    hit = F.coalesce(F.arrays_overlap(telling, words(F.col("query_text"))), F.lit(False)) & F.lit(cfg.keyword_match)
    blank = F.col("query_text") == ""
    score = F.when(~blank, F.when(near >= cfg.min_score, near + recency).when(hit, cfg.min_score + recency))
    scored = both.withColumn("score", score).filter(blank | F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc(F.round("score", 9)), "tier", "block_idx"))
    chosen = scored.filter(~blank).withColumn("rank", rank).filter(F.col("rank") <= cfg.retrieve_k)
    if cfg.mode == "mixC" and scorer:
        from loquent.operators.search import rerank_each

        ranked = rerank_each(chosen.withColumnRenamed("chat_id", "query_id").drop("score"), cfg.rerank_to, scorer)
        chosen = ranked.withColumnRenamed("query_id", "chat_id")
    every = scored.filter(blank).withColumn("score", F.lit(None).cast("double"))  # a chat with nothing to ask by recalls its bridge
    return _placed(chosen.select(*tiers.columns, "score").unionByName(every.select(*tiers.columns, "score")))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("chat_id").orderBy("seq_start", "tier")))


def format_block(rows: DataFrame) -> DataFrame:
    """chat_id and its recalled texts (text, place), trimmed, a blank line between; null where all are blank."""
    kept = rows.withColumn("__t", trimmed(F.col("text"))).groupBy("chat_id").agg(F.sort_array(F.collect_list(F.when(F.col("__t") != "", F.struct("place", "__t")))).alias("__b"))
    return kept.select("chat_id", F.nullif(F.array_join(F.transform("__b", lambda x: x["__t"]), "\n\n"), F.lit("")).alias("block"))
