import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loquent.operators import search, vectors

DIMS = 8


def vec(entries):
    v = [0.0] * DIMS
    for i, x in entries.items():
        v[i] = x
    size = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / size for x in v]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<float>, grp int")


CLUSTER = [(1, vec({0: 1}), 0), (2, vec({0: 1, 1: 0.1}), 0), (3, vec({0: 1, 2: 0.1}), 0), (4, vec({1: 1}), 0)]


def test_hub_scores_of_a_cluster_and_a_loner(spark):
    hubs = {r.id: r.hub for r in vectors.hub_scores(frame(spark, CLUSTER), 2).collect()}
    assert hubs[1] > 0.9 and hubs[4] < 0.2


def test_small_group_has_no_hubs(spark):
    assert {r.hub for r in vectors.hub_scores(frame(spark, CLUSTER), 4).collect()} == {0.0}


def test_correction_puts_the_specific_one_first(spark):
    rows = frame(spark, CLUSTER)
    held = rows.join(vectors.hub_scores(rows, 2).select("id", "hub"), "id")
    query = search.literal_vector(vec({0: 0.8, 1: 0.6}))
    assert vectors.nearest(held, query, 1).first().id == 2
    assert search.knn(held, query, 1).first().id == 4


def test_missing_hub_leaves_the_distance(spark):
    rows = frame(spark, CLUSTER).withColumn("hub", F.lit(None).cast("double"))
    got = search.knn(rows, search.literal_vector(vec({1: 1})), 2).collect()
    assert [r.id for r in got] == [4, 2] and all(r.rank_distance == r.distance for r in got)


def test_pairs_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rows = [(i, vec({i % 4: 1, 5: 0.01 * i}), 0) for i in range(20)]
    got = {(r.a, r.b) for r in vectors.pairs_above(frame(spark, rows), 0.9).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert got == {(a, b) for a, u, _ in rows for b, v, _ in rows if a < b and cos(u, v) >= 0.9}


def test_null_vectors_and_null_groups(spark):
    rows = frame(spark, [(1, vec({0: 1}), None), (2, vec({0: 1}), None), (3, None, None), (4, [0.0] * DIMS, None)])
    assert [(r.a, r.b) for r in vectors.pairs_above(rows, 0.5).collect()] == [(1, 2)]
    assert vectors.pairs_above(rows.limit(0), 0.5).count() == 0


def test_csls_subtracts_both_hubs(spark):
    pairs = vectors.pairs_above(frame(spark, [(1, vec({0: 1}), 0), (2, vec({0: 1}), 0)]), 0.92)
    hubs = spark.createDataFrame([(1, 0.5), (2, 0.3)], "id bigint, hub double")
    assert vectors.csls_pairs(pairs, hubs).first().csls == pytest.approx(1.2, abs=1e-5)


def test_kmeans_finds_blobs(spark):
    rows = frame(spark, [(i, vec({(i % 3) * 2: 1, 7: 0.01 * i}), 0) for i in range(30)])
    got = vectors.nearest_centroid(rows, vectors.kmeans(rows, 3)).collect()
    by = {}
    for r in got:
        by.setdefault(r.id % 3, set()).add(r.cluster)
    assert all(len(c) == 1 for c in by.values()) and len(set.union(*by.values())) == 3


def test_discover_groups_and_owner(spark):
    rows = spark.createDataFrame([(1, vec({0: 1}), "A", 1), (2, vec({0: 1, 1: 0.2}), "A", 1), (3, vec({0: 1, 1: 0.4}), "B", 2)], "id bigint, vec array<float>, who string, owner int").withColumn("hub", F.lit(0.0))
    query = search.literal_vector(vec({0: 1}))
    got = search.discover(rows, query, "who", 5).collect()
    assert [(r.who, r.matches, r.evidence) for r in got] == [("A", 2, [1, 2]), ("B", 1, [3])]
    assert [r.who for r in search.discover(rows, query, "who", 5, owner=F.col("owner") == 2).collect()] == ["B"]


def test_rerank_may_reverse(spark):
    hits = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma ray")], "id bigint, text string")
    got = search.rerank(hits, "gamma ray burst", "text").orderBy(F.desc("score")).first()
    assert got.id == 3


def test_graph_keeps_edges_of_kept_nodes(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (4, 5, 0.9)], "a bigint, b bigint, cosine double")
    nodes, edges = vectors.graph(pairs, 3)
    assert [r.id for r in nodes.collect()] == [1, 2, 3] and edges.count() == 2


def test_what_blocks_send_grows_with_the_rows_and_not_their_square(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rows = lambda n: spark.range(n).select("id", F.array(F.lit(1.0)).alias("vec"), F.lit(0).alias("grp"))
    assert vectors._blocks(rows(4000)).count() <= 4000 * 25
    assert vectors._blocks(rows(4000)).groupBy("grp", "one", "two").count().count() > 100  # and many tasks share them


@pytest.fixture
def tiled(spark, monkeypatch):
    """40 rows of two groups in blocks of 7 and tiles of 2, and their cosines."""
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "TILE", 2)
    x = np.random.default_rng(3).normal(size=(40, DIMS))
    x[9] = x[4]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return spark.createDataFrame([(i, x[i].tolist(), i % 2) for i in range(40)], "id bigint, vec array<double>, grp int"), x @ x.T


def test_tiles_of_blocks_against_brute_force(tiled):
    rows, sims = tiled
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2 and sims[a, b] >= 0.2}
    assert sorted((r.a, r.b) for r in vectors.pairs_above(rows, 0.2).collect()) == sorted(want) and want
    assert {r.id: r.degree for r in vectors.degrees(rows, 0.2).collect()} == {i: n for i in range(40) if (n := sum(i in p for p in want))}
    for r in vectors.hub_scores(rows, 3).collect():
        assert r.hub == pytest.approx(np.mean(sorted((sims[r.id, i] for i in range(40) if i % 2 == r.grp and i != r.id), reverse=True)[:3]))
    near = {}
    for r in vectors.nearest_each(rows.select(F.col("id").alias("query_id"), "vec"), rows, 5).collect():
        near.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
    assert {q: sorted(v) for q, v in near.items()} == {q: sorted((round(1 - sims[q, i], 9), i) for i in range(40) if i != q)[:5] for q in range(40)}


def test_csls_above_brings_hubs_along(tiled):
    rows, _ = tiled
    hubs = vectors.hub_scores(rows, 3).filter("id <> 4")  # a missing hub counts as 0
    one = rows.drop("grp").join(hubs.select("id", "hub"), "id", "left").withColumn("grp", F.lit(0))
    found = vectors.csls_above(one, 0.2)
    want = vectors.csls_pairs(vectors.pairs_above(rows.withColumn("grp", F.lit(0)), 0.2), hubs)
    shown = lambda df: sorted((r.a, r.b, round(r.cosine, 9), round(r.csls, 9)) for r in df.collect())
    assert shown(found) == shown(want) and found.count() > 50


def test_graph_above_equals_the_graph_of_all_pairs(tiled):
    rows, _ = tiled
    nodes, edges = vectors.graph_above(rows, 0.2, 9)
    want_nodes, want_edges = vectors.graph(vectors.pairs_above(rows, 0.2), 9)
    assert nodes.collect() == want_nodes.collect() and nodes.count() == 9
    shown = lambda df: sorted((r.a, r.b, round(r.cosine, 9)) for r in df.collect())
    assert shown(edges) == shown(want_edges) and edges.count()
