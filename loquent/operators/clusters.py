"""k-means of many groups at once, such as every owner's digests of every level, and the themes made of it.

Sums are whole numbers (units of 2^-32), so neither the order of rows nor how they are partitioned changes a result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.operators.dedupe import collapse
from loquent.operators.vectors import _unit
from loquent.sources.scratch import written

#: Rows of a group in one task, rows of a group that first centroids are chosen from, and the unit of sums.
BLOCK, SAMPLE, UNIT = 8192, 4096, 2.0**32


def chosen(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` rows of ``x`` (of length 1) by k-means++: each next one by chance, in proportion to the squared distance."""
    rng = np.random.default_rng(seed)
    out = [int(rng.integers(len(x)))]
    far = 2 - 2 * x @ x[out[0]]
    for _ in range(1, k):
        far[out] = 0
        total = np.maximum(far, 0).cumsum()
        if total[-1] <= 0:
            break
        out.append(int(np.searchsorted(total, rng.random() * total[-1], side="right")))
        far = np.minimum(far, 2 - 2 * x @ x[out[-1]])
    return x[out]


def _grouped(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """id, vec and ``grp``, the keys as one string, for rows with a vector."""
    return vectors.filter(F.col("vec").isNotNull()).select(F.to_json(F.struct(*keys)).alias("grp"), F.col("id").cast("bigint").alias("id"), "vec")


def first_centroids(rows: DataFrame, k: int | Column, seed: int) -> DataFrame:
    """grp, cluster, centre: chosen among the ``SAMPLE`` rows of each group with the least hashes. rows: with ``k``."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id"))
    some = rows.withColumn("__r", rank).filter(F.col("__r") <= SAMPLE).select("grp", "id", "vec", "k")

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        x = _unit(table)
        x = x[x.any(1)] if x.any() else x
        centres = chosen(np.unique(x, axis=0), table.column("k")[0].as_py(), seed)
        return pa.table({"grp": [table.column("grp")[0].as_py()] * len(centres), "cluster": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    return some.groupBy("grp").applyInArrow(choose, "grp string, cluster int, centre array<double>")


def _blocks(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    return written(rows.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")))


def _with_centres(blocks: DataFrame, centres: DataFrame, shape: str, run) -> DataFrame:  # noqa: ANN001
    """``run(ids, unit rows, centroids, group)`` on each block of rows with the centroids of its group, in one task each."""
    parts = blocks.select("grp", "block").distinct()
    held = centres.join(parts, "grp").select(F.col("grp").alias("grp"), F.col("block").alias("block"), "cluster", "centre")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        left, right = left.sort_by([("id", "ascending")]), right.sort_by([("cluster", "ascending")])
        dims = len(right.column("centre")[0])
        found = right.column("centre").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        return run(left.column("id").to_numpy(), _unit(left), found, left.column("grp")[0].as_py())

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
    none = pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in shape.split(", "))]).empty_table()
    rows = blocks.select(F.col("grp").alias("grp"), F.col("block").alias("block"), "id", "vec")
    return rows.groupBy("grp", "block").cogroup(held.groupBy("grp", "block")).applyInArrow(meet, shape)


def _sums(ids: np.ndarray, x: np.ndarray, centres: np.ndarray, grp: str) -> pa.Table:
    own = (x @ centres.T).argmax(1)
    total = np.zeros(centres.shape, np.int64)
    np.add.at(total, own, np.rint(x * UNIT).astype(np.int64))
    n = np.bincount(own, minlength=len(centres))
    return pa.table({"grp": [grp] * len(n), "cluster": pa.array(range(len(n)), pa.int32()), "total": pa.array(list(total), pa.list_(pa.int64())), "n": pa.array(n, pa.int64())})


def _farthest(ids: np.ndarray, x: np.ndarray, centres: np.ndarray, grp: str) -> pa.Table:
    """As many rows as there are centroids, farthest from theirs first."""
    far = (1 - (x @ centres.T).max(1)).round(12)
    order = np.lexsort((ids, -far))[: len(centres)]
    return pa.table({"grp": [grp] * len(order), "id": ids[order], "far": far[order], "centre": pa.array(list(x[order]), pa.list_(pa.float64()))})


def _assigned(ids: np.ndarray, x: np.ndarray, centres: np.ndarray, grp: str) -> pa.Table:
    sims = (x @ centres.T).round(12)
    own = sims.argmax(1)
    return pa.table({"grp": [grp] * len(ids), "id": ids, "cluster": pa.array(own, pa.int32()), "distance": 1 - sims[np.arange(len(ids)), own]})


def _moved(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """The next centroids: means of their rows; one without rows goes to the farthest row of its group, or a next one."""
    parts = _with_centres(blocks, centres, "grp string, cluster int, total array<bigint>, n bigint", _sums)
    parts = written(parts)  # a row a block and cluster
    sizes = parts.groupBy("grp", "cluster").agg(F.sum("n").alias("n"))
    places = parts.select("grp", "cluster", F.posexplode("total").alias("i", "x")).groupBy("grp", "cluster", "i").agg(F.sum("x").alias("x"))
    means = places.groupBy("grp", "cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))  # a row a dimension
    scaled = F.transform("v", lambda e: e["x"] / F.lit(UNIT))
    size = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda t, x: t + x * x))
    new = written(means.join(sizes, ["grp", "cluster"]).select("grp", "cluster", "n", F.transform(scaled, lambda x: x / F.when(size > 0, size).otherwise(1.0)).alias("centre")))
    empty = new.filter("n = 0").select("grp", "cluster")
    if not empty.limit(1).count():
        return new.select("grp", "cluster", "centre")
    lone = written(_with_centres(blocks.join(empty.select("grp").distinct(), "grp", "left_semi"), centres, "grp string, id bigint, far double, centre array<double>", _farthest))
    nth = lambda *order: F.row_number().over(Window.partitionBy("grp").orderBy(*order))  # noqa: E731  at most k rows a block
    seeds = lone.select("grp", nth(F.desc("far"), "id").alias("r"), "centre")
    filled = empty.withColumn("r", nth("cluster")).join(seeds, ["grp", "r"]).select("grp", "cluster", "centre")
    return written(new.filter("n > 0").select("grp", "cluster", "centre").unionByName(filled))


def kmeans(vectors: DataFrame, keys: Sequence[str], k: Column | int, rounds: int = 50, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Clusters of each group of rows (id, vec and ``keys``) by cosine, all groups in the same jobs.

    Returns centroids (grp, cluster, centre) and the rows with their cluster and distance (grp, id, cluster, distance);
    ``grp`` is the keys as JSON. ``k``: how many, a number or a column that is the same in a group; a group of fewer
    different rows has as many clusters as these. Ends when no centroid moves, or after ``rounds``; ties go to the first
    cluster, and what comes out doesn't depend on the order or the partitions of the rows.
    """
    kept = vectors.withColumn("__k", F.lit(k) if isinstance(k, int) else k)
    rows = _grouped(kept, keys)
    counts = kept.filter(F.col("vec").isNotNull()).select(F.to_json(F.struct(*keys)).alias("grp"), F.col("__k").alias("k")).groupBy("grp").agg(F.max("k").alias("k"))
    blocks = _blocks(rows.join(counts, "grp"))
    centres = written(first_centroids(blocks, k, seed))
    for _ in range(rounds):
        new = _moved(blocks, centres)
        same = new.join(centres.withColumnRenamed("centre", "__old"), ["grp", "cluster"]).filter(F.col("centre") != F.col("__old")).limit(1).count() == 0
        centres = new
        if same:
            break
    return centres, _with_centres(blocks, centres, "grp string, id bigint, cluster int, distance double", _assigned)


def themes(digests: DataFrame, k: Column, rounds: int = 50, seed: int = 1) -> DataFrame:
    """owner_id, level, id, cluster, distance: the theme of every digest among those of its owner and level.

    digests: id, vec, content_hash, owner_id, level; k: a column, how many themes a level has. Clusters are made of one
    digest of each hash, where there are more than ``k`` of these; then every row goes to its nearest one.
    """
    known = digests.filter(F.col("vec").isNotNull()).withColumn("__k", k)
    keyed = known.withColumn("__h", F.when(F.col("content_hash").isNotNull(), F.concat_ws("|", F.to_json(F.struct("owner_id", "level")), "content_hash")))
    one_each = written(collapse(keyed.select("__h", "id", "vec", "owner_id", "level", "__k"), "__h", "id"))
    enough = one_each.groupBy("owner_id", "level").agg(F.count("*").alias("__n"), F.max("__k").alias("__m")).filter("__n > __m").select("owner_id", "level")
    same = lambda left, right: left["owner_id"].eqNullSafe(right["owner_id"]) & left["level"].eqNullSafe(right["level"])
    fit = one_each.join(enough, same(one_each, enough), "left_semi")
    centres, _ = kmeans(fit.select("id", "vec", "owner_id", "level", "__k"), ["owner_id", "level"], F.col("__k"), rounds, seed)
    blocks = _blocks(_grouped(known, ["owner_id", "level"]))
    found = _with_centres(blocks, centres, "grp string, id bigint, cluster int, distance double", _assigned)
    return found.join(known.select("id", "owner_id", "level"), "id").select("owner_id", "level", "id", "cluster", "distance")
