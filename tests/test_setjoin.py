"""The set-similarity join against a comparison of all pairs, and numbers inside hot keys."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loquent.operators import ordering, setjoin


def plain(rows, least):
    sets = {}
    for key, member, scope in rows:
        if key is not None and member is not None:
            sets.setdefault((scope, key), set()).add(member)
    out = {}
    for (s, a), (t, b) in itertools.combinations(sorted(sets, key=str), 2):
        if s == t:
            x, y = sets[s, a], sets[t, b]
            if len(x & y) / len(x | y) >= least:
                out[min(a, b), max(a, b), s] = (len(x & y), round(len(x & y) / len(x | y), 9))
    return out


@pytest.mark.parametrize("least", [0.3, 0.5, 0.01, 1.0])
def test_pairs_equal_plain_comparison(spark, least):
    rng = random.Random(2)
    base = [[f"m{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    rows = []
    for key in range(160):
        members = list(rng.choice(base)) if rng.random() < 0.7 else [f"m{rng.randrange(200)}" for _ in range(5)]
        if rng.random() < 0.5:
            members[rng.randrange(len(members))] = "greeting"
        rows += [(key, m, rng.choice([1, 2]) if key % 7 == 0 else key % 2 or None) for m in members]
    rows += [(500, None, 1), (None, "greeting", 1), (3, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "key int, member string, scope int")
    got = {(r.a, r.b, r.scope): (r.shared, round(r.jaccard, 9)) for r in setjoin.similar_keys(frame, "key", "member", ["scope"], least).collect()}
    assert got == plain(rows, least)


def test_a_common_greeting_makes_no_candidates(spark):
    own = spark.range(10_000).select(F.col("id").alias("key"), F.explode(F.array(F.lit("greeting"), *[F.concat(F.lit(f"{i}-"), F.floor(F.col("id") / (2 if i < 5 else 1)).cast("string")) for i in range(9)])).alias("member"))
    sets, named = setjoin.classes(own, "key", "member", [])
    pairs = setjoin.candidates(setjoin.prefixes(sets, named, "member", [], 0.4), "member", [], 0.4)
    assert named.count() == 10_000 and pairs.count() == 5_000  # those that share half of their members
    found = setjoin.similar_keys(own, "key", "member", [], 0.4)
    assert found.count() == 5_000 and found.agg(F.min("shared"), F.max("shared")).first() == (6, 6)


def test_copies_stay_a_class_until_they_are_asked_for(spark):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.explode(F.array(F.lit("x"), F.lit("y"), F.when(F.col("id") % 3 == 0, "z"))).alias("member"))
    pairs, named = setjoin.similar_sets(rows, "key", "member", [], 0.6)
    assert [(r.a, r.b, r.shared) for r in pairs.collect()] == [(1, 0, 2)]
    assert {(r.rep, r.n) for r in named.groupBy("rep").agg(F.count("*").alias("n")).collect()} == {(0, 1000), (1, 2000)}


def test_least_is_checked_and_no_rows(spark):
    none = spark.createDataFrame([], "key int, member string")
    assert setjoin.similar_keys(none, "key", "member", [], 0.5).count() == 0
    with pytest.raises(ValueError):
        setjoin.similar_keys(none, "key", "member", [], 0)


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows become one range
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_numbers_and_totals_of_a_hot_key(spark, many_ranges):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(1, 5), i, rng.randrange(-9, 100)) for i in range(4000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k int, i int, v int").repartition(8)
    by = {}
    for k, i, v in sorted(rows):
        by.setdefault(k, []).append((i, v))
    want = {(k, i): (n, sum(v for _, v in held[: n + 1]), max(v for _, v in held[: n + 1])) for k, held in by.items() for n, (i, _) in enumerate(held)}
    numbers = {(r.k, r.i): r.nth for r in ordering.numbered(frame, ["k"], ["i"]).collect()}
    sums = {(r.k, r.i): r.total for r in ordering.running(frame, ["k"], ["i"], F.col("v")).collect()}
    tops = {(r.k, r.i): r.total for r in ordering.running(frame, ["k"], ["i"], F.col("v"), "max").collect()}
    assert want == {x: (numbers[x], sums[x], tops[x]) for x in want}
    held = ordering.ranged(frame, ["k"], ["i"]).groupBy("__range").count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 3000  # no task has the whole key
