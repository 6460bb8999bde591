"""The graph search against brute force: recall, exact scores, copies, odd rows."""

import numpy as np
import pytest

from loquent.llm import graphs, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(rows, k=5, every=50):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), [v / np.abs(v).max() for _, v in good]
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        own = min((tuple(map(float, v)), n) for n, (i, v) in enumerate(good) if i == q)[1]
        scored = [(-(x[own] @ x[n]) / np.sqrt((x[own] @ x[own]) * (x[n] @ x[n])), int(i)) for n, i in enumerate(ids) if i != q and len(x[n]) == len(x[own])]
        out[q] = sorted(scored)[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(found.get(q, [])) & {i for _, i in best}) for q, best in want.items())
    return hits / max(1, sum(map(len, want.values())))


def check(got, want, k=5):
    scores = {q: dict((i, -s) for s, i in best) for q, best in want.items()}
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        if r.vec_id in scores[r.query_id]:
            assert r.score == pytest.approx(scores[r.query_id][r.vec_id], abs=1e-12)
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert set(by) == {q for q, best in want.items() if best}


@pytest.mark.parametrize("shard_rows", [400, 8192])
def test_recall_on_scattered_and_clustered_vectors(spark, shard_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = np.concatenate([rng.normal(size=(1200, 24)), centres[rng.integers(0, 20, 1200)] + 0.05 * rng.normal(size=(1200, 24))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = graphs.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), shard_rows=shard_rows).collect()
    want = exact(rows)
    check(got, want)
    assert recall(got, want) >= 0.9


def test_copies_ties_and_odd_rows_are_exact_on_few_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 6)).astype(np.float32).round(2)
    rows = [(i, base[i % 30].tolist()) for i in range(120)]
    rows += [(i, base[0].tolist()) for i in range(200, 500)]  # one vector of most rows
    rows += [(600, None), (601, []), (650, [0.0] * 6), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, [float("nan")] * 6), (604, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, base[1].tolist())]
    rows += [(700, [1.0, 2.0]), (701, [2.0, 4.0]), (702, [-1.0, 0.5]), (750, [3.0]), (50, base[7].tolist()), (61, base[9].tolist()), (800, [3e38, 3e38, 0.0, 0.0, 0.0, 0.0]), (801, [1e-38, 1e-38, 0.0, 0.0, 0.0, 0.0])]
    got = graphs.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    want = exact(rows)
    check(got, want)
    assert recall(got, want) == 1
    assert {r.query_id for r in got} == {0, 50, 100, 200, 250, 300, 350, 400, 450, 700, 800}


def test_clashing_columns_and_no_rows(spark):
    rows = [(i, [float(i), 1.0], i, 0.5) for i in range(60)]
    got = graphs.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int, score double")).collect()
    check(got, exact([(i, v) for i, v, *_ in rows]))
    assert graphs.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert graphs.nearest(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0


def test_every_row_is_indexed(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = graphs.index(vectors).collect()
    assert sorted(i for r in rows for i in r.members) == sorted(r.vec_id for r in vectors.collect())
    assert all(len(set(r.edges)) == len(r.edges) <= graphs.DEGREE and r.slot not in r.edges for r in rows)


def test_pruning_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 8))
    x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
    nodes = np.arange(10)
    offered = np.array([rng.permutation(80)[:40] for _ in nodes], np.int32)
    offered[:, 5] = offered[:, 6]  # offered twice
    offered[:, 7] = -1
    far = lambda a, b: float(np.sqrt(max(0, 2 - 2 * x[a] @ x[b])))
    for node, row, got in zip(nodes, offered, graphs.pruned(x, nodes, offered.copy(), 6, 1.2)):
        left, kept = sorted({int(c) for c in row if c >= 0 and c != node}, key=lambda c: far(node, c)), []
        while left and len(kept) < 6:
            kept.append(left[0])
            left = [c for c in left[1:] if 1.2 * far(kept[-1], c) > far(node, c)]
        assert got[got >= 0].tolist() == kept


def test_query_recall(spark, sf):
    got = queries.op12_nearest(spark, sf).collect()
    want = exact([(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    check(got, want)
    assert recall(got, want) >= 0.9
