"""k-means of many groups against a plain run of each, and themes by owner and level."""

import json

import numpy as np
from pyspark.sql import functions as F

from loquent.operators import clusters


def plain(ids, x, k, seed=1, rounds=50):
    """Lloyd's rounds on one group, from the same first centroids."""
    order = np.argsort(ids)
    ids, x = ids[order], x[order] / np.sqrt((x[order] ** 2).sum(1, keepdims=True))
    centres = clusters.chosen(np.unique(x, axis=0), k, seed)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        new = centres.copy()
        empty = []
        for c in range(len(centres)):
            if (own == c).any():
                total = np.rint(x[own == c] * clusters.UNIT).sum(0)
                new[c] = total / np.sqrt((total * total).sum())
            else:
                empty.append(c)
        far = (1 - (x @ centres.T).max(1)).round(12)
        for c, at in zip(empty, np.lexsort((ids, -far))):
            new[c] = x[at]
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres, dict(zip(ids.tolist(), (x @ centres.T).round(12).argmax(1).tolist()))


def test_groups_equal_plain_runs_whatever_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6)) + 3 * rng.normal(size=(8, 6))[rng.integers(0, 8, 600)]
    owner = rng.integers(0, 3, 600)
    rows = [(i, int(owner[i]), x[i].tolist()) for i in range(600)] + [(1000 + i, 9, [float(i % 2), 1.0, 0, 0, 0, 0]) for i in range(6)] + [(2000, 1, None)]
    rows = [(i, o, None if v is None else list(map(float, v))) for i, o, v in rows]
    frame = spark.createDataFrame(rows, "id bigint, owner int, vec array<double>")
    results = []
    for parts, block in ((1, 8192), (7, 50)):
        monkeypatch.setattr(clusters, "BLOCK", block)  # more blocks, other tasks
        centres, assigned = clusters.kmeans(frame.repartition(parts), ["owner"], 5)
        results.append({r.id: (json.loads(r.grp)["owner"], r.cluster) for r in assigned.collect()})
    assert results[0] == results[1] and len(results[0]) == 606
    for o in range(3):
        mine = np.flatnonzero(owner == o)
        want = plain(mine, x[mine], 5)[1]
        assert {i: c for i, (g, c) in results[0].items() if g == o} == want
    assert len({c for _, (g, c) in results[0].items() if g == 9}) == 2  # two different rows make two clusters


def test_an_empty_cluster_goes_to_the_farthest_row(spark):
    rows = [(i, 0, [1.0, 0.01 * i]) for i in range(8)] + [(8, 0, [-1.0, 0.2]), (9, 0, [0.0, -1.0])]
    frame = spark.createDataFrame(rows, "id bigint, owner int, vec array<double>")
    blocks = clusters._blocks(clusters._grouped(frame, ["owner"]))
    held = spark.createDataFrame([('{"owner":0}', 0, [1.0, 0.0]), ('{"owner":0}', 1, [0.0, 1.0]), ('{"owner":0}', 2, [0.01, 0.9999])], "grp string, cluster int, centre array<double>")
    lone = held.withColumn("centre", F.when(F.col("cluster") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(-0.3), F.lit(0.95))))
    new = {r.cluster: r.centre for r in clusters._moved(blocks, lone).collect()}
    far = {8: [-1.0, 0.2], 9: [0.0, -1.0]}
    assert np.allclose(new[2], np.array(far[9]) / np.linalg.norm(far[9]))


def test_themes_by_owner_and_level(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), f"h{i % 40}", i % 2, "scene" if i % 3 else "arc") for i in range(300)]
    rows += [(900 + i, rows[0][1], "same", 7, "scene") for i in range(50)] + [(990, None, "x", 0, "scene"), (991, rows[1][1], None, 0, "arc")]
    frame = spark.createDataFrame(rows, "id bigint, vec array<double>, content_hash string, owner_id int, level string")
    got = clusters.themes(frame, F.when(F.col("level") == "scene", 5).otherwise(3)).collect()
    assert len(got) == 301 and {r.owner_id for r in got} == {0, 1}  # copies of one digest make no themes
    assert {(r.owner_id, r.level): len({x.cluster for x in got if (x.owner_id, x.level) == (r.owner_id, r.level)}) for r in got} == {(o, level): n for o in (0, 1) for level, n in (("scene", 5), ("arc", 3))}
