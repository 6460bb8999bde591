"""Digests of all tiers kept up to date: what changed below marks what is above it, and nothing else is built again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquent.operators.intervals import span_of
from loquent.operators.memory import MemoryConfig, blocks
from loquent.sources.scratch import written

#: Columns of stored digests.
STORED = ["chat_id", "tier", "block_idx", "seq_start", "seq_end", "text", "content_hash", "created_at"]
_SCHEMA = "chat_id bigint, tier int, block_idx int, seq_start bigint, seq_end bigint, text string, content_hash string, created_at bigint"


@dataclass(frozen=True)
class Upkeep:
    """The new state of the digests, the rows of it that were built now, and the keys of those that are gone."""

    state: DataFrame
    built: DataFrame
    gone: DataFrame


def aged_blocks(messages: DataFrame, cfg: MemoryConfig) -> DataFrame:
    """Blocks of messages behind the last ``verbatim`` ones, of chats with a whole block of these; the last may be shorter."""
    made = blocks(messages, cfg.block_size, aged=cfg.verbatim)
    return made.join(made.filter((F.col("block_idx") == 0) & (F.col("n") == cfg.block_size)).select("chat_id"), "chat_id", "left_semi")


def _as_stored(rows: DataFrame, tier: int) -> DataFrame:
    types = dict(part.split(" ") for part in _SCHEMA.split(", "))
    return rows.withColumn("tier", F.lit(tier)).select(*[F.col(c).cast(types[c]).alias(c) for c in STORED])


def _due(spans: DataFrame, stored: DataFrame, tier: int) -> DataFrame:
    """Spans (with ``changed_at``) that aren't stored, are stored with another span, or changed after they were stored; and the others."""
    old = stored.filter(F.col("tier") == tier).select("chat_id", "block_idx", F.col("seq_start").alias("__s"), F.col("seq_end").alias("__e"), F.col("created_at").alias("__at"))
    both = spans.join(old, ["chat_id", "block_idx"], "left")
    fits = (F.col("seq_start") == F.col("__s")) & (F.col("seq_end") == F.col("__e")) & F.coalesce(F.col("changed_at") <= F.col("__at"), F.lit(True))
    return both.withColumn("due", ~F.coalesce(fits, F.lit(False)))


def keep_up(messages: DataFrame, stored: DataFrame, edits: DataFrame, now: int, cfg: MemoryConfig = MemoryConfig(), summarise: Callable[[Column], Column] | None = None) -> Upkeep:
    """All chats' digests brought up to date at time ``now``.

    stored: the columns ``STORED``; edits: chat_id, seq, edited_at. A block of tier 0 is due where it is missing, has
    another span or holds a message edited after it was built. A block above is due where one of its ``fan_out``
    children was built after it, or where the same holds for itself; only due blocks meet texts. What has no place in
    the grid any more, or lies above ``max_tier``, goes. With nothing stored this builds every digest of every chat.
    """
    text = lambda c: summarise(c) if summarise else c
    base = written(aged_blocks(messages, cfg).select("chat_id", "block_idx", "seq_start", "seq_end", "text", "content_hash"))
    changes = span_of(edits.select("chat_id", "seq", "edited_at"), base).groupBy("chat_id", "block_idx").agg(F.max("edited_at").alias("changed_at"))
    spans = base.select("chat_id", "block_idx", "seq_start", "seq_end").join(changes, ["chat_id", "block_idx"], "left")
    marked = written(_due(spans, stored, 0))
    due = marked.filter("due").select("chat_id", "block_idx")
    rows = base.join(due, ["chat_id", "block_idx"], "left_semi").withColumn("text", text(F.col("text"))).withColumn("created_at", F.lit(now))
    built = [_as_stored(rows, 0)]
    kept = [_kept(stored, marked, 0)]
    for tier in range(1, cfg.max_tier + 1):
        below = marked.select("chat_id", F.floor(F.col("block_idx") / cfg.fan_out).cast("int").alias("block_idx"), F.col("block_idx").alias("__child"), "seq_start", "seq_end", F.when(F.col("due"), F.lit(now)).otherwise(F.col("__at")).alias("__built"))
        groups = below.groupBy("chat_id", "block_idx").agg(F.count("*").alias("__n"), F.min("seq_start").alias("seq_start"), F.max("seq_end").alias("seq_end"), F.max("__built").alias("changed_at"))
        marked = written(_due(groups.filter(F.col("__n") == cfg.fan_out).drop("__n"), stored, tier))
        due = marked.filter("due").select("chat_id", "block_idx", "seq_start", "seq_end")
        children = built[-1].unionByName(kept[-1]).select("chat_id", F.floor(F.col("block_idx") / cfg.fan_out).cast("int").alias("block_idx"), F.struct(F.col("block_idx").alias("i"), "text").alias("__c"))
        met = children.join(due, ["chat_id", "block_idx"]).groupBy("chat_id", "block_idx", "seq_start", "seq_end").agg(F.sort_array(F.collect_list("__c")).alias("__c"))  # fan_out rows
        joined = F.array_join(F.transform("__c", lambda x: x["text"]), "\n\n")
        built.append(_as_stored(met.select("chat_id", "block_idx", "seq_start", "seq_end", text(joined).alias("text"), F.lit(None).alias("content_hash"), F.lit(now).alias("created_at")), tier))
        kept.append(_kept(stored, marked, tier))
    made, old = _union(built), _union(kept)
    made = written(made)
    state = written(old.unionByName(made))
    gone = stored.select("chat_id", "tier", "block_idx").join(state, ["chat_id", "tier", "block_idx"], "left_anti")
    return Upkeep(state, made, gone)


def _kept(stored: DataFrame, marked: DataFrame, tier: int) -> DataFrame:
    fresh = marked.filter("not due").select("chat_id", "block_idx")
    return _as_stored(stored.filter(F.col("tier") == tier).join(fresh, ["chat_id", "block_idx"], "left_semi"), tier)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def replay(messages: DataFrame, now: int, cfg: MemoryConfig = MemoryConfig(), summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every digest of every chat, built from nothing."""
    spark = messages.sparkSession
    none = spark.createDataFrame([], "chat_id bigint, seq bigint, edited_at bigint")
    return keep_up(messages, spark.createDataFrame([], _SCHEMA), none, now, cfg, summarise).state
