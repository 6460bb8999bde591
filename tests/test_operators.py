import numpy as np
import pytest
from pyspark.sql import functions as F

from loquent.operators import catalog, dedupe, keywords, lexical, memory, segments, setjoin, stats


def test_overlap_pairs(spark):
    seg = lambda c, hs, o="o": [(c, h, o) for h in hs]
    rows = spark.createDataFrame(seg("x", ["h1", "h2", "h3", "h4"]) + seg("y", ["h1", "h2", "h3", "h9"]) + seg("z", ["h1", "z1", "z2", "z3", "z4"]) + seg("x", [None]) + seg("q", ["h1", "h2", "h3"], "other"), "chat string, h string, owner string")
    got = setjoin.similar_keys(rows, "chat", "h", ["owner"], 0.3).collect()
    assert [(r.a, r.b, r.shared) for r in got] == [("x", "y", 3)] and got[0].jaccard == pytest.approx(0.6)


def test_overlap_pairs_of_one_hot_hash(spark):
    rows = spark.createDataFrame([(i, "same", 1) for i in range(9)] + [(9, "same", 2), (3, "other", 1)], "chat int, h string, owner int")
    got = {(r.a, r.b): r.jaccard for r in setjoin.similar_keys(rows, "chat", "h", ["owner"], 0.3).collect()}
    assert got == {(a, b): 0.5 if 3 in (a, b) else 1.0 for a in range(9) for b in range(a + 1, 9)}


def test_fork_roots_and_cycles(spark):
    chats = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 6), (6, 5), (7, 99)], "chat_id bigint, parent_id bigint")
    roots = {r.chat_id: r.root for r in dedupe.fork_roots(chats).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_fork_roots_of_long_chains_and_cycles(spark):
    rows = [(1000 + i, 999 + i) for i in range(1, 300)] + [(1000, None)]  # one chain of 300
    rows += [(3000 + i, 3000 + (i + 1) % 77) for i in range(77)] + [(10, 3005), (9, 10), (5000, 5000)]  # a long cycle with a tail of lesser ids, and a chat that names itself
    roots = {r.chat_id: r.root for r in dedupe.fork_roots(spark.createDataFrame(rows, "chat_id bigint, parent_id bigint")).collect()}
    assert len(roots) == len(rows) and all(roots[1000 + i] == 1000 for i in range(300))
    assert all(roots[3000 + i] == 3000 for i in range(77)) and roots[10] == roots[9] == 3000 and roots[5000] == 5000


def test_overlap_pairs_past_a_thousand_keys(spark):
    rows = spark.createDataFrame([(i, "same", 1) for i in range(1200)], "chat int, h string, owner int")
    got = setjoin.similar_keys(rows, "chat", "h", ["owner"], 0.3)
    assert got.count() == 1200 * 1199 // 2 and got.select("jaccard").distinct().collect()[0].jaccard == 1.0


def test_chat_duplicates(spark):
    seg = lambda c, hs, o="o": [(c, o, "m", h) for h in hs]
    segs = spark.createDataFrame(seg(1, ["a", "b", "c"]) + seg(2, ["a", "b", "c"]) + seg(3, ["a", "b", "c", None]) + seg(4, ["a", "b", "c"]) + seg(5, ["a", "b", "c"], "p"), "chat_id bigint, owner_id string, model string, content_hash string")
    chats = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, None), (5, None)], "chat_id bigint, parent_id bigint")
    sizes = spark.createDataFrame([(1, 21), (2, 30), (3, 40), (4, 20), (5, 50)], "chat_id bigint, messages bigint")
    got = dedupe.chat_duplicates(segs, chats, sizes)
    assert sorted((r.a, r.b, r.relation, r.jaccard) for r in got.collect()) == [(1, 2, "forked", 1.0), (1, 3, "duplicate", 1.0), (2, 3, "duplicate", 1.0)]
    assert dedupe.duplicate_counts(got.limit(0), got).first().asDict() == {"characters": 0, "chats": 2}


def test_collapse_keeps_rows_without_hash(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "h string, id int")
    assert sorted((r.h or "", r.id, r.members) for r in dedupe.collapse(rows, "h", "id").collect()) == [("", 3, 1), ("", 4, 1), ("a", 1, 2)]


def test_cooccurrence(spark):
    d = spark.createDataFrame([(1, "c1", ["orchard", "moonlight"]), (2, "c1", ["orchard", "moonlight"]), (3, "c2", ["Orchard!", "the moonlight", "cat"])], "digest_id int, character_id string, keywords array<string>")
    rows = keywords.keyword_rows(d)
    got = keywords.cooccurrence(rows, sample=1).collect()
    assert [(r.a, r.b, r.n, r.characters) for r in got] == [("moonlight", "orchard", 3, ["c1"])]
    assert keywords.with_keyword(keywords.cooccurrence(rows), "orchard").first().keyword == "moonlight"
    assert keywords.without_hubs(rows, 0.5).count() == 0
    assert keywords.top_keywords(keywords.profiles(rows), "c1").count() == 2


def test_top_characters_counts_empty_chats(spark):
    chats = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "chat_id int, character_id int")
    m = spark.createDataFrame([(3,), (3,)], "chat_id int")
    assert [(r.character_id, r.chats, r.messages) for r in stats.top_characters(chats, m).collect()] == [(7, 2, 0), (8, 1, 2)]


def test_swipes_of_nothing(spark):
    assert stats.swipe_totals(spark.createDataFrame([], "message_id int")).first().average == 0.0


def test_log_tail_clamps_its_limit(spark):
    log = spark.range(2500).toDF("event_id")
    assert [stats.log_tail(log, limit=n).count() for n in (0, None, -5, 7, 9999)] == [100, 100, 100, 7, 2000]


def test_tags(spark):
    items = spark.createDataFrame([(1, ["A", "b", "a "]), (2, ["a", "B"]), (3, None)], "id int, tags array<string>")
    assert [(r.a, r.b, r.n) for r in catalog.tag_pairs(items, "tags").collect()] == [("a", "b", 2)]
    rows = catalog.tag_rows(items, "id", "tags")
    assert [(r.tag, r.n) for r in catalog.top_tags(rows).collect()] == [("a", 2), ("b", 2)]
    assert [r.tag for r in catalog.suggestions(rows, spark.createDataFrame([("B",)], "tag string"), "id", length=1).collect()] == ["a"]
    assert catalog.browse(items, tag="B").count() == 2
    links = spark.createDataFrame([(1, "a")], "key int, tag string")
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (9, "a")], "key int, tag string")
    assert catalog.apply_suggestions(links, wanted, rows.toDF("key", "tag")).count() == 2


def test_fsck(spark):
    import hashlib

    good = hashlib.sha256(b"x").hexdigest()
    files = spark.createDataFrame([(good, bytearray(b"x")), ("bad", bytearray(b"y")), (hashlib.sha256(b"z").hexdigest(), bytearray(b"z"))], "hash string, content binary")
    rows = spark.createDataFrame([(good,), ("bad",), ("gone",)], "hash string")
    assert sorted(r.state for r in catalog.fsck(files, rows).collect()) == ["corrupt", "dangling", "ok", "orphan"]


MESSAGES = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", 3) for i in range(9)] + [(1, 9, "system", "no", 3), (1, 10, "user", "  ", 3)]


def talk(spark):
    return spark.createDataFrame(MESSAGES, "chat_id bigint, seq bigint, role string, content string, character_id int")


def test_blocks_and_digests(spark):
    made = memory.blocks(talk(spark), 4).orderBy("block_idx").collect()
    assert [(r.seq_start, r.seq_end, r.n, r.seq_mid) for r in made] == [(0, 3, 4, 2), (4, 7, 4, 6), (8, 8, 1, 8)]
    assert made[2].text == "User: m8"
    cfg = memory.MemoryConfig(block_size=2, verbatim=1, fan_out=2, max_tier=2)
    tiers = memory.digests(talk(spark), cfg)
    assert sorted((r.tier, r.seq_start, r.seq_end) for r in tiers.collect()) == [(0, 0, 1), (0, 2, 3), (0, 4, 5), (0, 6, 7), (1, 0, 3), (1, 4, 7), (2, 0, 7)]
    assert [(r.tier, r.seq_start) for r in memory.bridge(tiers.filter("seq_end < 7")).orderBy("seq_start").collect()] == [(1, 0), (0, 4)]


def test_second_build_finds_nothing_stale(spark):
    fresh = memory.blocks(talk(spark), 2)
    stored = fresh.withColumn("created_at", F.lit(10))
    assert memory.stale(fresh, stored).count() == 0
    edits = spark.createDataFrame([(1, 2, 20), (1, 4, 5)], "chat_id bigint, seq bigint, edited_at int")
    assert [r.block_idx for r in memory.stale(fresh, stored, edits).collect()] == [1]
    shorter = fresh.filter("block_idx < 2")
    assert memory.refreshed(shorter, stored, stored.limit(0)).count() == 2


def test_recall(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 1, "alpha", [1.0, 0.0], []), (1, 0, 1, 2, 3, "beta", [0.0, 1.0], ["Hi-Nu Gundam"]), (1, 0, 2, 4, 5, "gamma", None, ["the sea"])], "chat_id bigint, tier int, block_idx int, seq_start bigint, seq_end bigint, text string, vec array<double>, keywords array<string>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    got = lambda text, **k: [r.text for r in memory.recall(rows, text, q, memory.MemoryConfig(mode="mixB", **k)).collect()]
    assert got("gundam") == ["alpha", "beta"] and got("the") == ["alpha"] and got("gundam", retrieve_k=1) == ["alpha"]
    assert memory.recall(rows, "x", q, memory.MemoryConfig(mode="off")).count() == 0
    assert [r.text for r in memory.recall(rows, "", q, memory.MemoryConfig(mode="tiered")).collect()] == ["alpha", "beta", "gamma"]


def test_fork_drops_accounts(spark):
    got = memory.fork(talk(spark).withColumn("cost", F.lit(1.0)), 1, 2, 3, ("cost",))
    assert got.count() == 4 and got.filter("cost is not null or chat_id <> 2").count() == 0


def test_windows_never_part_a_pair():
    user = [i % 2 == 0 for i in range(40)]
    spans = segments.windows([100] * 40, user, 2000, 512)
    assert spans[0][0] == 0 and spans[-1][1] == 39
    for _, end in spans:
        assert end == 39 or not user[end]
    assert segments.windows([10, 10], [True, False]) == [(0, 1)]


def test_windows_of_random_chats():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        sizes, user = rng.integers(1, 900, n), rng.random(n) < 0.5
        spans = segments.windows(sizes, user)
        assert {i for a, b in spans for i in range(a, b + 1)} == set(range(n)) and all(a <= b for a, b in spans)
        assert all(x[0] < y[0] for x, y in zip(spans, spans[1:]))
        if sizes.sum() <= 2000:
            assert spans == [(0, n - 1)]
            continue
        for a, b in spans[:-2]:  # the last may hold a rest
            assert sizes[a:b].sum() < 2000 and (b == n - 1 or not user[b] or user[b + 1] or b == a)
        for a, _ in spans[1:-1]:
            assert not user[a - 1] or user[a] or a == n - 1
    assert segments.windows([1500, 400, 300, 700, 900], [True, False, True, False, False]) == [(0, 1), (2, 4), (4, 4)]  # place 1 would part a pair


def test_segments_keep_whole_messages(spark):
    long = "y" * 20_000
    rows = spark.createDataFrame([(1, 0, "user", "hi", 3), (1, 1, "assistant", long, 3), (1, 2, "user", "bye", 3), (2, 0, "system", "x", 3)], "chat_id bigint, seq bigint, role string, content string, character_id int")
    got = sorted((r.idx, r.total, r.seq_start, r.seq_end, long in r.text) for r in segments.segment(rows).collect())
    assert got == [(0, 2, 0, 1, True), (1, 2, 2, 2, False)]
    assert all(len(r.text) < 9000 for r in segments.segment(rows, most_chars=8000).collect())


def test_segments_need_a_user(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "hello", 3), (2, 0, "user", "hi <b>x</b>", 3)], "chat_id bigint, seq bigint, role string, content string, character_id int")
    got = segments.segment(rows).collect()
    assert [(r.chat_id, r.text) for r in got] == [(2, "[Character: 3 | Chat: 2 | Segment 1/1]\n\nUser: hi x")]


def test_lexical_search(spark):
    docs = spark.createDataFrame([(1, "the red fox", "fox"), (2, "a red dog", None), (3, "foxes run", "zoo")], "id bigint, text string, name string")
    ix = lexical.index(docs, ("text", "name"))
    assert [r.id for r in lexical.search(ix, "red fox", {"name": 6.0}).collect()] == [1]
    assert [r.id for r in lexical.search(ix, "fox", {"name": 6.0}).collect()] == [1, 3]
    assert [r.id for r in lexical.search(ix, "foxez", {}, prefix=False).collect()] == [3]
    assert lexical.search(ix, "", {}).count() == 0
    assert lexical.suggest(ix, "fo").first().suggestion == "fox"


def test_batches_stay_in_budget(spark):
    rows = spark.createDataFrame([(i, 150 + i) for i in range(300)], "id bigint, tokens bigint")
    got = segments.packed_batches(rows, 4096).groupBy("part", "batch").agg((F.max("tokens") * F.count("*")).alias("padded")).collect()
    assert max(r.padded for r in got) <= 4096


def test_duplicates_are_counted_from_degrees(spark):
    chats = spark.createDataFrame([(1, 2, "duplicate"), (2, 3, "forked")], "a int, b int, relation string")
    ends = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id bigint, degree bigint")  # pairs 1-2 and 1-3
    half = (F.sum("degree") / 2).cast("long")
    assert dedupe.duplicate_counts(ends, chats, half).first().asDict() == {"characters": 2, "chats": 1}
