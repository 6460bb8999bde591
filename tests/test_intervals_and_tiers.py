"""Sweeps against a comparison of all spans, a chat of very many messages, and upkeep of tiers."""

import random

import pytest
from pyspark.sql import functions as F

from loquent.operators import intervals, memory, tiers


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows become one range
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_sweeps_equal_comparison(spark, many_ranges):
    rng = random.Random(3)
    spans = []
    for i in range(400):
        start = rng.randrange(300)
        spans.append((rng.choice([1, 1, 1, 2, 3]), rng.randrange(4), i, start, start + rng.randrange(0, 60)))
    frame = spark.createDataFrame([*spans, (None, 0, 900, 1, 2)], "chat_id int, tier int, block_idx int, seq_start int, seq_end int")
    got = {r.block_idx for r in intervals.uncovered(frame).collect()}
    want = {i for c, t, i, s, e in spans if not any(c == c2 and t2 > t and s2 <= s and e2 >= e for c2, t2, _, s2, e2 in spans)}
    assert got == want | {900}

    points = [(c, p, c * 1000 + p) for c in (1, 2, 3) for p in rng.sample(range(360), 200)]
    table = spark.createDataFrame(points, "chat_id int, seq int, at int")
    got = {r.block_idx: r["at"] for r in intervals.middle_of(frame.filter("chat_id is not null"), table, "at").collect()}
    want = {}
    for c, t, i, s, e in spans:
        inside = sorted(p for c2, p, _ in points if c2 == c and s <= p <= e)
        if inside:
            want[i] = c * 1000 + inside[len(inside) // 2]
    assert got == want

    cuts = sorted(rng.sample(range(0, 350, 2), 40))
    apart = [(c, i, a, b) for c in (1, 2) for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    got = sorted((r.chat_id, r.seq, r.block_idx) for r in intervals.span_of(table, spark.createDataFrame(apart, "chat_id int, block_idx int, seq_start int, seq_end int")).collect())
    assert got == sorted((c, p, i) for c, p, _ in points for c2, i, a, b in apart if c == c2 and a <= p <= b)


def test_one_chat_of_a_hundred_thousand_messages(spark, many_ranges):
    chat = spark.range(100_000).select(F.lit(1).alias("chat_id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"))
    made = memory.blocks(chat, 8)
    assert made.agg(F.count("*"), F.max("n"), F.min("n"), F.max("block_idx")).first() == (12_500, 8, 8, 12_499)
    windows = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("__range" in w and "content" not in w for w in windows)
    every = memory.digests(chat, memory.MemoryConfig(block_size=8, verbatim=8, fan_out=4, max_tier=3))
    kept = memory.bridge(every.drop("text"))
    assert {r.tier: r["count"] for r in kept.groupBy("tier").count().collect()} == {0: 3, 2: 1, 3: 195}
    middle = intervals.middle_of(every.select("chat_id", "tier", "block_idx", "seq_start", "seq_end"), chat.select("chat_id", "seq", (F.col("seq") * 10).alias("at")), "at")
    wrong = middle.join(every, ["chat_id", "tier", "block_idx"]).filter("at <> 10 * (seq_start + floor((seq_end - seq_start + 1) / 2))")
    assert middle.count() == every.count() and wrong.count() == 0


CFG = memory.MemoryConfig(block_size=2, verbatim=1, fan_out=2, max_tier=2)


def chat_rows(spark, n, text=lambda c, s: f"{c}-{s}"):
    return spark.createDataFrame([(c, s, "user", text(c, s)) for c, count in n.items() for s in range(count)], "chat_id bigint, seq bigint, role string, content string")


def test_only_ancestors_of_changes_are_built(spark):
    stored = tiers.replay(chat_rows(spark, {1: 17, 2: 17}), 100, CFG)
    assert {(r.chat_id, r.tier): r["count"] for r in stored.groupBy("chat_id", "tier").count().collect()} == {(c, t): n for c in (1, 2) for t, n in ((0, 8), (1, 4), (2, 2))}
    edits = spark.createDataFrame([(1, 5, 200), (2, 3, 50)], "chat_id bigint, seq bigint, edited_at bigint")
    now = tiers.keep_up(chat_rows(spark, {1: 17, 2: 17}, lambda c, s: "new" if (c, s) == (1, 5) else f"{c}-{s}"), stored, edits, 300, CFG)
    assert sorted((r.chat_id, r.tier, r.block_idx) for r in now.built.collect()) == [(1, 0, 2), (1, 1, 1), (1, 2, 0)]
    assert "new" in now.built.filter("tier = 2").first().text and now.gone.count() == 0
    again = tiers.keep_up(chat_rows(spark, {1: 17, 2: 17}), now.state, edits, 400, CFG)
    assert again.built.count() == 0 and again.state.count() == now.state.count()
    lost = now.state.filter("not (tier = 1 and block_idx = 3 and chat_id = 2)")
    assert sorted((r.chat_id, r.tier, r.block_idx) for r in tiers.keep_up(chat_rows(spark, {1: 17, 2: 17}), lost, edits, 400, CFG).built.collect()) == [(2, 1, 3), (2, 2, 1)]


def test_what_has_no_place_goes_and_what_comes_is_built(spark):
    stored = tiers.replay(chat_rows(spark, {1: 17, 2: 9, 3: 5}), 100, CFG)
    none = spark.createDataFrame([], "chat_id bigint, seq bigint, edited_at bigint")
    now = tiers.keep_up(chat_rows(spark, {1: 10, 2: 13, 4: 3, 5: 2}), stored, none, 300, CFG)
    key = lambda df: sorted((r.chat_id, r.tier, r.block_idx) for r in df.collect())
    assert key(now.gone) == [(1, 0, 5), (1, 0, 6), (1, 0, 7), (1, 1, 2), (1, 1, 3), (1, 2, 1), (3, 0, 0), (3, 0, 1), (3, 1, 0)]
    # a shorter last block counts where there is a whole one; a chat with less is left alone
    assert key(now.built) == [(1, 0, 4), (2, 0, 4), (2, 0, 5), (2, 1, 2), (4, 0, 0)]
    whole = tiers.replay(chat_rows(spark, {1: 10, 2: 13, 4: 3, 5: 2}), 300, CFG)
    text = lambda df: {(r.chat_id, r.tier, r.block_idx): (r.text, r.content_hash) for r in df.collect()}
    assert text(now.state) == text(whole)
    lower = memory.MemoryConfig(block_size=2, verbatim=1, fan_out=2, max_tier=1)
    assert {r.tier for r in tiers.keep_up(chat_rows(spark, {1: 17}), stored, none, 300, lower).gone.filter("chat_id = 1").collect()} == {2}
