from collections import defaultdict

import pytest

import corpus_pipeline
from loquent.llm import jaccard, queries
from tests.compare import same_rows
from tests.llm.test_operators import brute_links, brute_repeats, docs_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


def test_there_is_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_stages_on_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    good = corpus_pipeline.keep_good(spark, docs, sf)
    assert good.columns == corpus_pipeline.COLUMNS and 0 < good.count() < before
    single = corpus_pipeline.keep_one_of_each(spark, good, sf).cache()
    texts = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {i for i, (c, _) in brute_links(texts).items() if c == i}
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, single, sf).collect()}
    want = brute_repeats([(r.doc_id, r.text) for r in single.collect()])
    assert cut == {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}
    assert len(jaccard._FIND.findall("a b")) == 2


def test_run_is_the_stages_in_turn(spark, sf):
    packed = corpus_pipeline.run(spark, sf).collect()
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert packed and max(fill.values()) <= 1024
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "best-fit packing"]


def test_stages_with_odd_rows(spark, sf):
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, "a b c d e f g")]
    docs = docs_of(spark, texts)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


ODD = [(1, "one two three four five six seven " * 9), (1, "one two three four five six seven " * 9), (2, None), (3, ""), (4, " \n "), (5, "é日本🙂 " * 40), (None, "one two three four five six seven " * 9), (6, "long words go on " * 30_000), (7, "one two three four five six seven " * 9 + "eight")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_odd_rows_and_clashing_columns(spark, sf, name):
    """Nulls, empty and very long texts, ties and repeats, null sources, and columns named as operators name theirs."""
    docs = docs_of(spark, ODD, lambda i: None if i in (2, 5) else f"s{(i or 0) % 2}")
    clashing = docs.selectExpr("*", "1 as size", "'x' as spans", "2 as class_id", "3 as links", "4 as copies", "5 as kept", "6 as key", "7 as rank", "8 as length")
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = sorted(map(repr, stage(spark, docs, sf).collect()))
    assert sorted(map(repr, stage(spark, clashing, sf).collect())) == plain
    got = stage(spark, docs, sf)
    ids = {r.doc_id for r in got.collect()}
    if name == "quality classifier":
        assert ids <= {i for i, _ in ODD} and got.columns == corpus_pipeline.COLUMNS
    elif name == "n-gram Jaccard join":
        assert sorted(i or -1 for i in [r.doc_id for r in got.collect()]) == [-1, 1, 2, 3, 4, 5, 6]  # 7 is a near copy of 1; a null id stays
    elif name == "suffix-array dedup":
        by = {r.doc_id: r.text for r in got.collect() if r.doc_id not in (1, None)}
        assert got.count() == len(ODD) and by[7] != ODD[-1][1] and by[2] == "" and by[5] == ODD[5][1]
    elif name == "mixing sources":
        assert got.columns == corpus_pipeline.COLUMNS and got.filter("doc_id in (2, 3, 4)").count() <= 9
    else:
        rows = got.collect()
        fill = defaultdict(list)
        for r in rows:
            fill[r.sequence_id].append((r.offset, r.length))
        for parts in fill.values():
            assert sum(n for _, n in parts) <= 1024 and [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert len({(r.doc_id, r.piece) for r in rows}) <= len(rows) and ids == {i for i, _ in ODD}
