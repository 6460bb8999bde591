"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import pytest

from loquent.llm import common, ranked

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in tf]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items.items():
        scored = []
        for (i, c), n in zip(tf, sizes):
            score = 0
            for w in terms(text):
                if c[w]:
                    m = 75 + 25 * n * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}" if rng.random() < 0.9 else rng.choice(["É", "é", "ÀB", "日本", "x1", "THE", "the"])
    docs = [(i, rng.choice([" ", ", ", "_"]).join(word() for _ in range(rng.randrange(1, 80)))) for i in range(300)]
    docs += [(i + 400, docs[5][1]) for i in range(40)] + [(5, docs[5][1])]  # ties and a repeated id
    docs += [(900, None), (901, ""), (902, "..."), (None, docs[5][1]), (903, "the w1 " * 60_000)]
    items = {i: " ".join(word() for _ in range(rng.randrange(1, 30))) for i in range(25)} | {50: docs[5][1], 51: "the the THE w1", 52: "nowhere", 53: "", 54: docs[5][1] + " w1"}
    return docs, items


@pytest.mark.parametrize("shard_rows", [20, 8192])
@pytest.mark.parametrize("few", [True, False])
def test_search_equals_plain_scores(spark, texts, shard_rows, few, monkeypatch):
    docs, items = texts
    if not few:
        monkeypatch.setattr(ranked, "BROADCAST_ROWS", 10)  # then all terms are indexed and joins are shuffled
        monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items.items()] + [(None, "w1", "x"), (50, "zz", "x"), (60, None, "x")], "item_id bigint, text string, term string")
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, score int")
    got = sorted(tuple(r) for r in ranked.ranked(table, asked, 20, shard_rows).collect())
    assert got == plain(docs, items, 20)


def test_proof_ends_pairs_before_the_last_tier(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(30)) + (" seldom seen phrase" if i % 25 == 3 else "")) for i in range(200)]
    index = common.materialize(ranked.tiers(common.materialize(ranked.lists(spark.createDataFrame(docs, "doc_id bigint, text string"), shard_rows=5))), "tier")
    by_tier = {r.tier: r.n for r in index.filter("tier >= 0").selectExpr("tier", "size(at) as n").groupBy("tier").sum("n").toDF("tier", "n").collect()}
    assert sorted(by_tier) == [0, 1, 2] and by_tier[0] < by_tier[1]
    read, whole_round = [], ranked._round
    monkeypatch.setattr(ranked, "_round", lambda pairs, index, upto, k: read.append((upto, pairs.count())) or whole_round(pairs, index, upto, k))
    items = {1: "seldom seen phrase w1", 2: "w1 w2 w3 w4"}
    asked = ranked.item_terms(spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    assert sorted(tuple(r) for r in ranked.search(index, asked, 5).collect()) == plain(docs, items, 5)
    (_, every), (last, leading), *deeper = read
    assert every == 80 and last == 2 and 5 <= leading <= 10
    assert sum(n for upto, n in deeper if upto == 2) <= every - leading - 30  # the first item is done in all shards without its words


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranked.ranked(none, items).count() == 0
    assert ranked.ranked(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), items.limit(0)).count() == 0
    assert ranked.ranked(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), items).count() == 0
