"""Searches inside scopes, of which one is hot, and what chats recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loquent.operators import memory, search, vectors


def test_nearest_rows_of_a_scope(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)  # the hot scope is met in blocks
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8))
    scope = np.where(rng.random(700) < 0.6, 0, rng.integers(1, 9, 700))
    rows = [(i, int(scope[i]), x[i].tolist()) for i in range(700)] + [(900, None, x[0].tolist()), (901, 3, None)]
    asked = [r for r in rows if r[0] % 7 == 0 and r[1] != 8] + [(5000, 77, x[0].tolist()), (5001, None, x[0].tolist())]
    got = {}
    frame = spark.createDataFrame(rows, "id bigint, owner int, vec array<double>")
    for r in vectors.nearest_in_scope(spark.createDataFrame(asked, "query_id bigint, owner int, vec array<double>"), frame, 4, "owner").collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = {}
    for i, s, v in asked:
        if s is not None and v is not None and i < 700:
            near = sorted((round(float(1 - unit[i] @ unit[j]), 9), j) for j in range(700) if scope[j] == s and j != i)[:4]
            if near:
                want[i] = near
    assert {q: sorted(n) for q, n in got.items()} == want


def test_every_search_keeps_to_its_scope(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, rng.normal(size=4).tolist(), 0.1, i % 5, i % 2, i // 10, i % 7) for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, owner int, vec array<double>, hub double, character_id int, tier int, block_idx int, chat_id int")
    asked = frame.filter("id < 20").select(F.col("id").alias("query_id"), "owner", "vec")
    tables = {"characters": frame.filter("id % 2 = 0"), "segments": frame, "digests": frame}
    for over in ("characters", "segments", "scenes", "arcs", "mix"):
        found = search.search_each(over, tables, asked, k=3, scope="owner").collect()
        assert len(found) == 60 and all(r.id % 3 == r.query_id % 3 for r in found)
    grouped = search.search_each("segments", tables, asked, "character", 3, "owner").collect()
    assert grouped and all(i % 3 == r.query_id % 3 for r in grouped for i in r.evidence)


SCHEMA = "chat_id bigint, tier int, block_idx int, seq_start bigint, seq_end bigint, text string, vec array<double>, keywords array<string>"


@pytest.fixture
def digests(spark):
    return spark.createDataFrame(
        [
            (1, 0, 0, 0, 1, "old scene", [1.0, 0.0], None),
            (1, 1, 0, 0, 3, "arc", [0.0, 1.0], ["The Lantern"]),
            (1, 0, 2, 4, 5, " ", [1.0, 1.0], ["lamp"]),
            (1, 0, 3, 6, 7, "late", None, ["日本"]),
            (2, 0, 0, 0, 1, "else", [1.0, 0.0], ["lantern"]),
        ],
        SCHEMA,
    )


def test_recall_of_many_chats_equals_recall_of_each(spark, digests):
    asked = spark.createDataFrame([(1, "the lantern and 日本", [1.0, 0.1]), (2, "", [0.0, 1.0]), (3, "x", None)], "chat_id bigint, query_text string, vec array<double>")
    for mode in ("off", "mixA", "tiered", "mixB", "mixC"):
        cfg = memory.MemoryConfig(mode=mode, recency_bias=0.1, retrieve_k=2, rerank_to=1)
        scorer = search.overlap_scorer if mode == "mixC" else None
        every = [(r.chat_id, r.tier, r.block_idx) for r in memory.recall_each(digests, asked, cfg, scorer).orderBy("chat_id", "place").collect()]
        each = []
        for chat, text, vec in ((1, "the lantern and 日本", [1.0, 0.1]), (2, "", [0.0, 1.0])):
            own = memory.recall(digests.filter(F.col("chat_id") == chat), text, search.literal_vector(vec), cfg, scorer)
            each += [(r.chat_id, r.tier, r.block_idx) for r in own.collect()]
        assert every == each, mode


def test_block_of_recalled_texts(spark, digests):
    cfg = memory.MemoryConfig(mode="tiered")
    asked = spark.createDataFrame([(1, "x", [1.0, 0.0])], "chat_id bigint, query_text string, vec array<double>")
    assert memory.format_block(memory.recall_each(digests, asked, cfg)).first().block == "arc\n\nlate"
    blank = memory.recall_each(digests.filter("block_idx = 2"), asked, cfg)
    assert memory.format_block(blank).first().block is None
