"""Blocks of chats kept up to date by a stream of messages: state by chat and block, and only blocks that changed come out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SCHEMA = "chat_id bigint, block_idx int, seq_start bigint, seq_end bigint, n bigint, seq_mid bigint, text string, content_hash string, revision bigint"
_HELD = "seqs array<bigint>, versions array<bigint>, lines array<string>, told string"
#: Keyed state of several kinds lies in this store.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

Message = tuple[int, int, str]


class _Blocks(StatefulProcessor):
    """State of a chat: each block's messages under its number, the number of blocks, and the last revision.

    A message is found by a search for its block between the first and the last one, so a batch reads and writes only
    blocks that it touches. A message that comes or goes before the end moves all after it, block by block.
    """

    def __init__(self, size: int, char: str, user: str):
        self.size, self.char, self.user = size, char, user

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "block_idx int", _HELD)
        self.facts = handle.getValueState("facts", "blocks int, revision bigint")

    def close(self) -> None:
        pass

    def _read(self, i: int) -> list[Message]:
        got = self.held.getValue((i,))
        return list(zip(got[0], got[1], got[2]))

    def _block_of(self, seq: int, n: int) -> int:
        """The last block that begins at ``seq`` or before; the first one if none does."""
        low, high = 0, n - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.held.getValue((mid,))[0][0] <= seq else (low, mid - 1)
        return max(0, low)

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:
        n, revision = self.facts.get() if self.facts.exists() else (0, 0)
        latest: dict[int, tuple[int, str | None]] = {}
        for r in rows:
            if r.seq is not None and (r.seq not in latest or r.version >= latest[r.seq][0]):
                latest[r.seq] = (r.version, self._line(r.role, r.content))
        changed: dict[int, bool] = {}
        moves: list[int] = []
        placed: dict[int, int] = {}
        for seq, (version, line) in sorted(latest.items()):
            i = placed[seq] = self._block_of(seq, n) if n else 0
            known = {s: v for s, v, _ in self._read(i)} if n else {}
            if seq in known and version < known[seq]:
                del latest[seq]
            elif (seq in known) == (line is None):
                moves.append(min(i, n - 1) if n else 0)
            elif line is None:
                del latest[seq]
        begin = min(moves, default=n)
        for i in sorted({placed[s] for s in latest if placed[s] < begin}):
            merged = self._merged(self._read(i), {s: x for s, x in latest.items() if placed[s] == i})
            changed[i] = self._write(i, merged)
        if moves:
            n = self._move(begin, n, {s: x for s, x in latest.items() if placed[s] >= begin}, changed)
        yield from self._told(key[0], sorted(i for i, new in changed.items() if new), n, revision + 1)
        self.facts.update((n, revision + 1))

    def _line(self, role: str | None, content: str | None) -> str | None:
        """The line of a message in a transcript; None for those that don't count."""
        text = re.sub(r"^\s+|\s+$", "", content or "", flags=re.ASCII)
        return f"{self.user if role == 'user' else self.char}: {text}" if text and role is not None and role != "system" else None

    def _merged(self, messages: list[Message], new: dict[int, tuple[int, str | None]]) -> list[Message]:
        both = {s: (s, v, line) for s, v, line in messages} | {s: (s, v, line) for s, (v, line) in new.items()}
        return [both[s] for s in sorted(both) if both[s][2] is not None]

    def _write(self, i: int, messages: list[Message]) -> bool:
        """Stores a block; whether it is another than the one last told."""
        told = self.held.getValue((i,))[3] if self.held.containsKey((i,)) else ""
        seqs, versions, lines = zip(*messages)
        mark = hashlib.sha256(repr((seqs, lines)).encode()).hexdigest()
        self.held.updateValue((i,), (list(seqs), list(versions), list(lines), mark))
        return mark != told

    def _move(self, begin: int, n: int, new: dict[int, tuple[int, str | None]], changed: dict[int, bool]) -> int:
        """Deals the messages from block ``begin`` on anew; what is held at once is a block and what has come in. The number of blocks."""
        ready: list[Message] = []
        out = begin
        for i in range(begin, n):
            messages = self._read(i)
            here = dict(new) if i == n - 1 else {s: x for s, x in new.items() if s <= messages[-1][0]}
            new = {s: x for s, x in new.items() if s not in here}
            ready += self._merged(messages, here)
            while len(ready) >= self.size and out <= i:
                changed[out] = self._write(out, ready[: self.size])
                ready, out = ready[self.size :], out + 1
        ready += self._merged([], new)
        while ready:
            changed[out] = self._write(out, ready[: self.size])
            ready, out = ready[self.size :], out + 1
        for i in range(out, n):
            self.held.removeKey((i,))
            changed[i] = True
        return out

    def _told(self, chat: int, blocks: list[int], n: int, revision: int) -> Iterator[Row]:
        for i in blocks:
            if i >= n:  # there is no such block any more
                yield Row(chat_id=chat, block_idx=i, seq_start=None, seq_end=None, n=0, seq_mid=None, text=None, content_hash=None, revision=revision)
                continue
            seqs, _, lines, _ = self.held.getValue((i,))
            text = "\n\n".join(lines)
            yield Row(chat_id=chat, block_idx=i, seq_start=seqs[0], seq_end=seqs[-1], n=len(seqs), seq_mid=seqs[len(seqs) // 2], text=text, content_hash=hashlib.sha256(text.encode()).hexdigest(), revision=revision)


def changed_blocks(messages: DataFrame, size: int = 8, char: str = "Character", user: str = "User") -> DataFrame:
    """A stream of the blocks that a stream of messages (chat_id, seq, role, content, version) makes, changes or ends.

    A message comes again with a higher ``version`` when it is edited; without content it is deleted. Blocks are those
    of ``memory.blocks``; each row has its chat's ``revision``, and n = 0 where a block is gone.
    """
    spark = messages.sparkSession
    spark.conf.set(*_STORE)
    rows = messages.filter("chat_id is not null").select(F.col("chat_id").cast("bigint").alias("chat_id"), F.col("seq").cast("bigint").alias("seq"), "role", "content", F.coalesce(F.col("version").cast("bigint"), F.lit(0)).alias("version"))
    return rows.groupBy("chat_id").transformWithState(_Blocks(size, char, user), SCHEMA, "Append", "None")


def keep(messages: DataFrame, path: str, checkpoint: str, size: int = 8) -> StreamingQuery:
    """Adds the changed blocks of each batch to the Parquet table under ``path``; a restart goes on from the checkpoint."""
    rows = changed_blocks(messages, size)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(changes: DataFrame) -> DataFrame:
    """The blocks as they are: of each the row of the last revision, without those that are gone."""
    columns = [c for c in changes.columns if c not in ("chat_id", "block_idx", "revision")]
    last = changes.groupBy("chat_id", "block_idx").agg(F.max_by(F.struct(*columns), "revision").alias("x"))
    return last.select("chat_id", "block_idx", "x.*").filter("n > 0")


def compacted(changes: DataFrame, path: str) -> None:
    """Writes just the last revision of each block under another path, in the form of ``changed_blocks``."""
    columns = [c for c in changes.columns if c not in ("chat_id", "block_idx")]
    changes.groupBy("chat_id", "block_idx").agg(F.max_by(F.struct(*columns), "revision").alias("x")).select("chat_id", "block_idx", "x.*").write.parquet(path)
