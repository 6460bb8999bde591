"""Vector operators. Pairs are compared by blocks with matrix products, not row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.functions.values import cosine
from loquent.sources.scratch import written

#: Rows of a block at least, blocks of a group where its rows allow it, and rows of a block at most.
BLOCK, BLOCKS, LARGEST = 256, 24, 65_536
#: Rows of each side in one matrix product; a block is met in tiles of so many.
TILE = 2048


def _unit(table: pa.Table) -> np.ndarray:
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(table.num_rows, -1)
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(size == 0, 1, size)


def _block_rows(n: Column) -> Column:
    """Rows of a block where ``n`` rows meet: with ``BLOCKS`` blocks what is sent grows as the rows, not as their square."""
    return F.least(F.greatest(F.lit(BLOCK), F.ceil(n / BLOCKS)), F.lit(LARGEST))


def _blocks(vectors: DataFrame, *more: str) -> DataFrame:
    """Each row once for each other block of its group: grp, one <= two, block, id, vec and columns ``more``."""
    sound = vectors.filter(F.col("vec").isNotNull())
    sizes = sound.groupBy("grp").agg(F.count("*").alias("__c")).select("grp", F.ceil(F.col("__c") / _block_rows(F.col("__c"))).cast("int").alias("__n"))
    rows = sound.join(sizes, sound["grp"].eqNullSafe(sizes["grp"])).drop(sizes["grp"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.select("id", "vec", "grp", "block", F.least("block", "__other").alias("one"), F.greatest("block", "__other").alias("two"), *more)


def _products(table: pa.Table, ordered: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in the table of rows of two blocks and their cosines, tile by tile; of pairs inside a block each once, the rest as -inf.

    Not ``ordered``: both sides of a block with itself, a row with itself as -inf.
    """
    block = table.column("block").to_numpy()
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    unit = _unit(table)
    a, b = np.nonzero(block == one)[0], np.nonzero(block == two)[0]
    for i in range(0, len(a), TILE):
        left = unit[a[i : i + TILE]]
        for j in range(i if one == two and ordered else 0, len(b), TILE):
            sims = left @ unit[b[j : j + TILE]].T
            if one == two and i == j:
                sims[np.tril_indices(len(sims)) if ordered else np.diag_indices(len(sims))] = -np.inf
            yield a[i : i + TILE], b[j : j + TILE], sims


def pairs_above(vectors: DataFrame, least: float, carried: str | None = None) -> DataFrame:
    """a < b and their cosine, for each pair of one group (columns id bigint, vec, grp) with a cosine of ``least`` or more.

    ``carried``: a column of doubles that pairs get from both rows, as ``<name>_a`` and ``<name>_b``.
    """
    more = [carried] if carried else []

    def each(table: pa.Table) -> pa.Table:
        ids, extra = table.column("id").to_numpy(), table.column(carried).to_numpy() if carried else None
        out = []
        for left, right, sims in _products(table):
            i, j = np.nonzero(sims >= least)
            x, y = left[i], right[j]
            swap = ids[x] > ids[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            out.append((ids[x], ids[y], sims[i, j], *((extra[x], extra[y]) if carried else ())))
        if not out:
            return pa.table(dict(zip(names, [np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * (len(names) - 2)])))
        return pa.table(dict(zip(names, map(np.concatenate, zip(*out)))))

    names = ["a", "b", "cosine", *[f"{c}_{side}" for c in more for side in "ab"]]
    shape = "a bigint, b bigint, " + ", ".join(f"{n} double" for n in names[2:])
    return _blocks(vectors, *more).groupBy("grp", "one", "two").applyInArrow(each, shape)


def degrees(vectors: DataFrame, least: float) -> DataFrame:
    """id and in how many of ``pairs_above`` it is, for rows in any; tasks send on a row a vector, not the pairs."""

    def each(table: pa.Table) -> pa.Table:
        n = np.zeros(table.num_rows, np.int64)
        for left, right, sims in _products(table):
            near = sims >= least
            n[left] += near.sum(1)
            n[right] += near.sum(0)
        some = n > 0
        return pa.table({"id": table.column("id").to_numpy()[some], "n": n[some]})

    found = _blocks(vectors).groupBy("grp", "one", "two").applyInArrow(each, "id bigint, n bigint")
    return found.groupBy("id").agg(F.sum("n").alias("degree"))


def hub_scores(vectors: DataFrame, k: int = 10) -> DataFrame:
    """id, grp and the mean cosine of the ``k`` nearest of the same group; 0 in groups of ``k`` or fewer.

    Each pair of blocks sends on ``k`` values per row at most.
    """

    def each(table: pa.Table) -> pa.Table:
        best = np.full((table.num_rows, k), -np.inf)
        same = table.column("one")[0].as_py() == table.column("two")[0].as_py()
        for left, right, sims in _products(table, ordered=False):
            for at, s in ((left, sims),) if same else ((left, sims), (right, sims.T)):
                both = np.concatenate([best[at], s], axis=1)
                best[at] = -np.partition(-both, k - 1, axis=1)[:, :k]
        sims, ids = best.ravel(), np.repeat(table.column("id").to_numpy(), k)
        sound = np.isfinite(sims)
        return pa.table({"id": ids[sound], "sim": sims[sound]})

    near = _blocks(vectors).groupBy("grp", "one", "two").applyInArrow(each, "id bigint, sim double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim")))
    best = near.withColumn("__rank", rank).filter(F.col("__rank") <= k).groupBy("id").agg(F.avg("sim").alias("__hub"), F.count("*").alias("__n"))
    sound = vectors.filter(F.col("vec").isNotNull()).select("id", "grp")
    hub = F.when(F.col("__n") >= k, F.col("__hub")).otherwise(F.lit(0.0))
    return sound.join(best, "id", "left").select("id", "grp", hub.alias("hub"))


def csls_pairs(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs with csls = 2 cos - hub a - hub b; a missing hub counts as 0."""
    hub = lambda side: hubs.select(F.col("id").alias(side), F.col("hub").alias(f"__{side}"))
    both = pairs.join(hub("a"), "a", "left").join(hub("b"), "b", "left")
    csls = 2 * F.col("cosine") - F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))
    return both.select("a", "b", "cosine", csls.alias("csls"))


def csls_above(vectors: DataFrame, least: float) -> DataFrame:
    """``csls_pairs`` of ``pairs_above``: vectors (id, vec, grp, hub) bring their hubs along, so pairs are joined with nothing."""
    found = pairs_above(vectors.withColumn("hub", F.coalesce(F.col("hub").cast("double"), F.lit(0.0))), least, "hub")
    return found.select("a", "b", "cosine", (2 * F.col("cosine") - F.col("hub_a") - F.col("hub_b")).alias("csls"))


def nearest(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """The ``k`` rows nearest to one query vector, with ``distance`` = 1 - cosine; filters belong before."""
    scored = vectors.filter(F.col("vec").isNotNull()).withColumn("distance", 1 - cosine(F.col("vec"), query))
    return scored.orderBy("distance", "id").limit(k)


def _nearest(asked: np.ndarray, x: np.ndarray | None, ids: np.ndarray, y: np.ndarray | None, k: int) -> pa.Table:
    """query_id, id and distance of the ``k`` rows nearest to each query in one block of both, tile by tile, with ties at the end."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(asked) if len(ids) else 0, TILE):
        q = asked[at : at + TILE]
        kth = np.full((len(q), 1), np.inf)  # no row beyond the k-th of any tile so far is among the k nearest
        for to in range(0, len(ids), TILE):
            far = 1 - x[at : at + TILE] @ y[to : to + TILE].T
            far[q[:, None] == ids[to : to + TILE]] = np.inf
            n = min(k, far.shape[1])
            last = np.partition(far, n - 1, axis=1)[:, n - 1 : n]
            if n == k:
                kth = np.minimum(kth, last)
            i, j = np.nonzero((far <= np.minimum(last, kth)) & np.isfinite(far))
            out.append((q[i], ids[to + j], far[i, j]))
    query, row, far = (np.concatenate(c) for c in zip(*out))
    return pa.table({"query_id": query, "id": row, "distance": far})


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id and ``distance`` of the ``k`` rows nearest to each query (query_id, vec), itself left out.

    Blocks of queries meet blocks of rows (id bigint, vec), one matrix product in a task; each sends on ``k`` rows a
    query, and more only where distances are equal. Ties go to the smaller id.
    """
    queries, vectors = queries.filter(F.col("vec").isNotNull()), vectors.filter(F.col("vec").isNotNull())
    n_q, n_r = (df.count() for df in (queries, vectors))
    # rows are sent once for each block of queries, of which there are far fewer, so these are larger
    n_q, n_r = (max(1, -(-n // min(max(least, -(-n // BLOCKS)), LARGEST))) for n, least in ((n_q, 32 * BLOCK), (n_r, BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select(F.col("query_id").cast("bigint").alias("id"), "vec", F.lit(True).alias("asked"), slot("query_id", n_q).alias("one"), every(n_r).alias("two"))
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "vec", F.lit(False).alias("asked"), every(n_q).alias("one"), slot("id", n_r).alias("two"))

    def each(table: pa.Table) -> pa.Table:
        is_query, ids = table.column("asked").to_numpy(), table.column("id").to_numpy()
        unit = _unit(table)
        return _nearest(ids[is_query], unit[is_query], ids[~is_query], unit[~is_query], k)

    found = asked.unionByName(rows).groupBy("one", "two").applyInArrow(each, "query_id bigint, id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def nearest_in_scope(queries: DataFrame, vectors: DataFrame, k: int, scope: str) -> DataFrame:
    """``nearest_each`` among the rows of each query's own ``scope`` (a column of both), such as an owner or a chat.

    A scope's queries meet only its rows, a large one's in pairs of blocks; scopes that nothing asks in are not read
    further, and a null scope has no rows.
    """
    sound = lambda df: df.filter(F.col("vec").isNotNull() & F.col(scope).isNotNull())
    queries, vectors = sound(queries).withColumnRenamed(scope, "scope"), sound(vectors).withColumnRenamed(scope, "scope")
    blocks = lambda df, name: df.groupBy("scope").agg(F.count("*").alias("c")).select("scope", F.ceil(F.col("c") / _block_rows(F.col("c"))).cast("int").alias(name))
    sizes = written(blocks(queries, "n_q").join(blocks(vectors, "n_r"), "scope"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = queries.join(sizes, "scope").select("scope", F.col("query_id").cast("bigint").alias("query_id"), "vec", slot("query_id", "n_q").alias("one"), every("n_r").alias("two"))
    rows = vectors.join(sizes, "scope").select("scope", F.col("id").cast("bigint").alias("id"), "vec", every("n_q").alias("one"), slot("id", "n_r").alias("two"))
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, ids = left.column("query_id").to_numpy(), right.column("id").to_numpy()
        some = len(q) and len(ids)
        return _nearest(q, _unit(left) if some else None, ids, _unit(right) if some else None, k)

    keys = ["scope", "one", "two"]
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, "query_id bigint, id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """The mean vector of each key, not normalised; tasks send on one sum a key, not their rows."""
    kind = dict(vectors.dtypes)[key]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            codes = batch.column(0).dictionary_encode("encode")
            total = np.zeros((len(codes.dictionary), rows.shape[1]))
            np.add.at(total, codes.indices.to_numpy(), rows)
            n = np.bincount(codes.indices.to_numpy(), minlength=len(total))
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(list(total), pa.list_(pa.float64())), pa.array(n)], [key, "total", "n"])

    parts = vectors.filter(F.col("vec").isNotNull()).select(key, "vec").mapInArrow(sums, f"`{key}` {kind}, total array<double>, n bigint")
    # a row a place and key from each task, added before the shuffle; a key's own rows never meet in a list
    sizes = parts.groupBy(key).agg(F.sum("n").alias("__n"))
    places = parts.select(key, F.posexplode("total").alias("__i", "__x")).groupBy(key, "__i").agg(F.sum("__x").alias("__x"))
    added = places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__i", "__x"))).alias("__v"))  # a row a dimension
    both = added.join(sizes, added[key].eqNullSafe(sizes[key])).select(added[key], "__v", "__n")
    return both.select(key, F.transform("__v", lambda x: x["__x"] / F.col("__n")).alias("vec"))


def nearest_centroid(vectors: DataFrame, few: list[tuple[int, list[float]]]) -> DataFrame:
    """id, the nearest of a few centroids by cosine (ties to the first), and its distance."""
    ids = np.array([i for i, _ in few], np.int64)
    unit = np.array([v for _, v in few], np.float64)
    size = np.sqrt((unit * unit).sum(1, keepdims=True))
    unit = unit / np.where(size == 0, 1, size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = _unit(pa.Table.from_batches([batch])) @ unit.T
                best = sims.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids[best]), pa.array(1 - sims[np.arange(len(best)), best])], ["id", "cluster", "distance"])

    return vectors.filter(F.col("vec").isNotNull()).select("id", "vec").mapInArrow(assign, "id bigint, cluster bigint, distance double")


def kmeans(vectors: DataFrame, k: int, seed: int = 1, rounds: int = 50, weight: str | None = None) -> list[tuple[int, list[float]]]:
    """``k`` centroids by Spark's own k-means on the cosine, or as many as there are rows.

    Rows are dealt out in parts of a like size first: what a task holds doesn't depend on how few files there are.
    ``weight``: a column with how often a row counts.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dealt = vectors.filter(F.col("vec").isNotNull()).select("vec", *([weight] if weight else [])).hint("rebalance")
    rows = dealt.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), *([F.col(weight).cast("double").alias(weight)] if weight else []))
    k = min(k, rows.count())
    if k < 2:
        return [(0, r["vec"]) for r in centroids(vectors.withColumn("__all", F.lit(0)), "__all").collect()]  # one row
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine", **({"weightCol": weight} if weight else {})).fit(rows)
    return [(i, list(map(float, c))) for i, c in enumerate(model.clusterCenters())]


def graph(pairs: DataFrame, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of highest degree, and the edges between them."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    nodes = ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(most)
    kept = nodes.select("id")
    edges = pairs.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").join(kept.withColumnRenamed("id", "b"), "b", "left_semi")
    return nodes, edges


def graph_above(vectors: DataFrame, least: float, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """``graph`` of ``pairs_above``, without making all pairs: degrees are counted where blocks meet, edges are those of the kept."""
    nodes = degrees(vectors, least).orderBy(F.desc("degree"), "id").limit(most)
    return nodes, pairs_above(vectors.join(F.broadcast(nodes.select("id")), "id", "left_semi"), least)  # ``most`` rows


def cluster_facets(assigned: DataFrame, facts: DataFrame, key: str = "id", most: int = 12) -> DataFrame:
    """Per cluster: size, most common value of each fact (ties to the least) and the first ``most`` members."""
    joined = assigned.join(facts, key)
    modes = [F.mode(c, True).alias(c) for c in facts.columns if c != key]
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(key))
    first = joined.select("cluster", key).withColumn("__rank", rank).filter(F.col("__rank") <= most)
    first = first.groupBy("cluster").agg(F.sort_array(F.collect_list(key)).alias("members"))
    return joined.groupBy("cluster").agg(F.count("*").alias("size"), *modes).join(first, "cluster")
