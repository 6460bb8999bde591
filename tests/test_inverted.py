"""Searches through the index of cells against a comparison with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loquent.operators import inverted


def clustered(n, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    return centres[rng.integers(0, 20, n)] + 0.1 * rng.normal(size=(n, dims))


def plain(rows, queries, k):
    unit = lambda v: v / (np.sqrt(v @ v) or 1)
    ids, x = np.array([i for i, v in rows if v is not None]), np.array([unit(np.array(v)) for _, v in rows if v is not None])
    out = {}
    for q, v in queries:
        d = 1 - x @ unit(np.array(v))
        order = [i for i in np.lexsort((ids, d.round(12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), round(float(d[i]), 9)) for i in order]
    return out


def got(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.distance, 9)))
    return {q: sorted(x, key=lambda p: (p[1], p[0])) for q, x in out.items()}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1500))]
    rows += [(2000 + i, rows[7][1]) for i in range(60)] + [(3000, [0.0] * 12), (3001, [0.0] * 12), (3002, None)]
    path = str(tmp_path_factory.mktemp("cells") / "index")
    inverted.build(spark.createDataFrame(rows, "id bigint, vec array<double>"), path, per_cell=40)
    return rows, path


def test_answers_are_exact_and_few_cells_are_read(spark, table):
    rows, path = table
    cells = inverted.opened(spark, path)
    assert int(cells.rows.sum()) == len(rows) - 1 and len(cells.number) > 30
    asked = [(i, v) for i, v in rows if i % 50 == 0 and v is not None] + [(-1, [1.0] * 12)]
    queries = spark.createDataFrame(asked, "query_id bigint, vec array<double>")
    found, read = inverted.nearest_each(cells, queries, 5)
    want, have = plain(rows, asked, 5), got(found)
    assert {q: [d for _, d in x] for q, x in have.items()} == {q: [d for _, d in x] for q, x in want.items()}
    assert all(x == want[q] for q, x in have.items() if len({d for _, d in x}) == 5)
    share = {r.query_id: r.cells_read for r in inverted.shares(cells, read).collect()}
    assert np.mean([x for q, x in share.items() if q >= 0 and q != 3000]) < 0.5
    assert share[3000] == 1  # a query without length is as far from all rows


def test_fewer_cells_give_an_approximate_answer(spark, table):
    rows, path = table
    cells = inverted.opened(spark, path)
    asked = [(i, v) for i, v in rows if i % 50 == 0 and i < 1500]
    found, read = inverted.nearest_each(cells, spark.createDataFrame(asked, "query_id bigint, vec array<double>"), 5, most_cells=4)
    want, have = plain(rows, asked, 5), got(found)
    recall = np.mean([len({i for i, _ in have[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall > 0.9 and read.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 5


def test_large_cells_are_met_in_blocks_and_rows_appended(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(300, 5, 3))]
    path = str(tmp_path / "index")
    frame = lambda part: spark.createDataFrame(part, "id bigint, vec array<double>")
    inverted.build(frame(rows[:200]), path, per_cell=50)
    inverted.append(frame(rows[200:] + [(900, [0.0] * 5)]), path)
    cells = inverted.opened(spark, path)
    assert int(cells.rows.sum()) == 301 and cells.number.tolist() == [-1, 0, 1, 2, 3]
    asked = [(i, v) for i, v in rows if i % 30 == 0]
    found, _ = inverted.nearest_each(cells, spark.createDataFrame(asked, "query_id bigint, vec array<double>"), 4)
    assert got(found) == plain(rows + [(900, [0.0] * 5)], asked, 4)


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "index")
    inverted.build(spark.createDataFrame([], "id bigint, vec array<double>"), path)
    cells = inverted.opened(spark, path)
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, vec array<double>")
    assert inverted.nearest_each(cells, asked, 3)[0].count() == 0


def test_no_batch_meets_all_centroids_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "TILE", 8)
    x = np.random.default_rng(5).normal(size=(300, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    seen, angles = [], inverted._angles
    monkeypatch.setattr(inverted, "_angles", lambda x, c: (seen.append(len(x)), angles(x, c))[1])
    centres = inverted.fitted(rows, 20)
    batch = rows.coalesce(1).toArrow().combine_chunks().to_batches()
    taken = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, shape: taken.append(f) or df)
    inverted.dealt(rows, centres)
    made = list(taken[0](iter(batch)))
    assert max(seen) <= 8 and sum(b.num_rows for b in made) == 300
    monkeypatch.undo()
    inverted.build(rows, str(tmp_path / "i"), 20)
    cells = inverted.opened(spark, str(tmp_path / "i"))
    found, _ = inverted.nearest_each(cells, rows.select(F.col("id").alias("query_id"), "vec"), 5, first=1)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = {}
    for r in found.collect():
        near.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
    far = 1 - unit @ unit.T
    assert {q: sorted(v) for q, v in near.items()} == {q: sorted((round(far[q, i], 9), i) for i in range(300) if i != q)[:5] for q in range(300)}
