"""Overlapping windows of a chat by token budget, that never part a user's message from its answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.functions.text import approx_tokens, clean_text, trimmed


def windows(sizes: np.ndarray, user: np.ndarray, target: int = 2000, least: int = 512, overlap: float = 0.5) -> list[tuple[int, int]]:
    """First and last message of each window over one chat.

    A window takes messages until their tokens reach ``target`` and gives back those after its last good end: the
    chat's end, an answer, or a message of the user that another one follows. The next one begins ``overlap`` of its
    messages further, moved on to where it follows a good end. A rest under ``least`` tokens joins the last window.
    Where each window from each place ends and what comes after it is looked up in prefix sums, for all places at once.
    """
    sizes, user = np.asarray(sizes, np.int64), np.asarray(user, bool)
    n, sums = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    if sums[-1] <= target:
        return [(0, n - 1)]
    at = np.arange(n)
    good = np.concatenate((~user[:-1] | user[1:], [True]))
    last_good = np.maximum.accumulate(np.where(good, at, -1))
    reach = np.minimum(np.searchsorted(sums, sums[:-1] + target), n) - 1
    ends = np.maximum(at, last_good[reach])
    follows = np.concatenate(([True], good[:-1]))  # places that a window may begin at
    follows[-1] = True
    next_place = np.append(np.minimum.accumulate(np.where(follows, at, n)[::-1])[::-1], n)
    after = next_place[np.minimum(at + np.maximum(1, ((ends - at + 1) * overlap).astype(np.int64)), n)]
    out, begin = [], 0
    while begin < n:
        out.append((begin, int(ends[begin])))
        begin = int(after[begin])
    first, last = out[-1]
    rest = sums[-1] - sums[last + 1]
    if last < n - 1:
        out[-1:] = [(first, last), (last + 1, n - 1)] if rest >= least else [(first, n - 1)]
    return out


def window_members(messages: DataFrame, target: int = 2000, least: int = 512) -> DataFrame:
    """chat_id, idx and seq of each message of each window. messages: chat_id, seq (both bigint), tokens, is_user.

    A task holds 13 bytes of each message of one chat at a time, never its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # parts of the chat that may go on in the next batch

        def done() -> pa.RecordBatch:
            chat, seq, tokens, user = (np.concatenate(x) for x in zip(*held))
            spans = windows(tokens, user, target, least)
            idx = np.repeat(np.arange(len(spans)), [b - a + 1 for a, b in spans])
            member = np.concatenate([seq[a : b + 1] for a, b in spans])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), chat[0])), pa.array(idx.astype(np.int32)), pa.array(member)], ["chat_id", "idx", "seq"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("chat_id", "seq", "tokens", "is_user")]
            edges = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and held[-1][0][-1] != columns[0][a]:
                        yield done()
                        held = []
                    held.append(tuple(c[a:b] for c in columns))
        if held:
            yield done()

    rows = messages.select("chat_id", "seq", F.col("tokens").cast("int").alias("tokens"), "is_user")
    return rows.repartition("chat_id").sortWithinPartitions("chat_id", "seq").mapInArrow(run, "chat_id bigint, idx int, seq bigint")


def segment(messages: DataFrame, target: int = 2000, least: int = 512, most_chars: int | None = None) -> DataFrame:
    """Windows of each chat: index, total, span of seqs and text under a line that names them. Chats without a user have none.

    ``most_chars`` cuts each message to its beginning, as encoders of a fixed length want it; by default messages stay
    whole, and one over the target is a window of its own. Windows are laid out from sizes alone; texts are joined after.
    """
    content = F.col("content") if most_chars is None else F.substring("content", 1, most_chars)
    spoken = messages.filter((F.col("role") != "system") & (trimmed(F.col("content")) != ""))
    spoken = spoken.select(F.col("chat_id").cast("bigint").alias("chat_id"), F.col("seq").cast("bigint").alias("seq"), (F.col("role") == "user").alias("is_user"), content.alias("content"), "character_id")
    asked = spoken.filter("is_user").select("chat_id").distinct()
    sizes = spoken.join(asked, "chat_id", "left_semi").select("chat_id", "seq", "is_user", approx_tokens(F.col("content")).alias("tokens"))
    member = window_members(sizes, target, least)
    total = member.groupBy("chat_id").agg((F.max("idx") + 1).alias("total"))
    text = clean_text(F.col("content"))
    line = F.when(text != "", F.concat(F.when(F.col("is_user"), "User: ").otherwise("Character: "), text))
    made = member.join(spoken, ["chat_id", "seq"]).groupBy("chat_id", "idx").agg(
        F.min("seq").alias("seq_start"),
        F.max("seq").alias("seq_end"),
        F.min_by("character_id", "seq").alias("character_id"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]).alias("lines"),  # of one window
    )
    head = F.format_string("[Character: %s | Chat: %d | Segment %d/%d]\n", F.col("character_id").cast("string"), "chat_id", F.col("idx") + 1, "total")
    made = made.join(total, "chat_id").withColumn("text", F.array_join(F.concat(F.array(head), F.filter("lines", lambda x: x.isNotNull())), "\n"))
    return made.select("chat_id", "idx", "total", "seq_start", "seq_end", "text")


def packed_batches(texts: DataFrame, budget: int = 32_768, least_tokens: int = 150) -> DataFrame:
    """Texts (id, tokens) in batches whose longest text times their number stays within ``budget``; short ones are dropped.

    Batches are formed inside each range of lengths, so no task sees all texts.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, n = 0, 0
        for part in parts:
            out = []
            for tokens in part["tokens"]:
                if n and (n + 1) * max(tokens, 1) > budget:
                    batch, n = batch + 1, 0
                out.append(batch)
                n += 1
            yield part.assign(batch=out)

    long = texts.filter(F.col("tokens") >= least_tokens).select("id", "tokens")
    dealt = long.repartitionByRange("tokens", "id").sortWithinPartitions("tokens", "id").withColumn("part", F.spark_partition_id())
    return dealt.mapInPandas(run, "id bigint, tokens bigint, part int, batch int")
