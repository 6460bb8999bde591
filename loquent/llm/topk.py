"""Exact top-k by inner product: columnar branch-and-bound over blocks of queries and candidates.

Candidates lie in vertical layout, one row per dimension. Scores accumulate over blocks of dimensions; after each
block a candidate whose score so far plus the most that the remaining mass can add (the product of the norms of
both rests) is below the query's k-th score goes, and those that stay are compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions added between two rounds of pruning.
STEP = 16
#: Scores beyond this may not be exact as doubles; beyond long they stop at its ends.
EXACT = float(2**52)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with an id and a vector without null or non-finite components, as ``id`` and ``v`` (doubles)."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def best_of(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best candidates, ties to the smaller id; columns: dimension by candidate."""
    dims, n = columns.shape
    at = np.flatnonzero(ids != own)
    score = np.zeros(len(at))
    floor = -np.inf
    for block, begin in enumerate(range(0, dims, STEP)):
        end = min(begin + STEP, dims)
        part = columns[begin:end] if len(at) == n else columns[begin:end, at]
        score += query[begin:end] @ part
        if end == dims or len(at) <= k:
            continue
        if begin == 0:  # the scores of those that lead after one block bound the k-th score from below
            lead = at[np.argpartition(-score, k - 1)[:k]]
            floor = (query @ columns[:, lead]).min()
        most = np.sqrt(np.square(query[end:]).sum()) * rest[block, at]
        stay = score + most * (1 + 1e-9) + 1e-6 >= floor
        at, score = at[stay], score[stay]
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at[order]], score[order]


def block_best(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    wide = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(rows.shape[1], 1) >= EXACT
    if wide:
        whole = [[int(x) for x in r] for r in rows]
    columns = np.ascontiguousarray(rows.T)
    starts = range(0, columns.shape[0], STEP)
    rest = np.array([np.sqrt(np.square(columns[s + STEP :]).sum(0)) for s in starts]) if len(starts) else np.zeros((1, len(ids)))
    for own, query in zip(q_ids, queries):
        if wide:
            exact = [int(x) for x in query]
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(exact, w)))), int(i)) for i, w in zip(ids, whole) if i != own)[:k]
            found, scores = [i for _, i in scored], [-s for s, _ in scored]
        else:
            best, values = best_of(query, own, ids, columns, rest, k)
            found, scores = best.tolist(), np.rint(values).astype(np.int64).tolist()
        out[0].extend([int(own)] * len(found))
        out[1].extend(found)
        out[2].extend(scores)
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", query_rows: int = 2048, least_rows: int = 1024, most_rows: int = 65_536) -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``k`` best other rows by integer inner product.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties to the smaller id.
    Rows with a null id, a null vector or a null or non-finite component take no part; vectors meet only those of
    equal length; fewer than ``k`` others give that many rows; rows with the query's id aren't candidates for it,
    and rows that repeat another id are candidates each. No rows give none; other columns don't matter. Queries and
    candidates meet in blocks of bounded size, and each pair of blocks sends on ``k`` rows for a query at most.
    """
    good = usable(vectors, id_col, vector)
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    counts = good.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query.cast("int")), F.lit(0)).alias("q")).first()
    q_blocks = max(1, -(-counts["q"] // query_rows))
    c_blocks = max(1, -(-counts["n"] // max(least_rows, min(most_rows, counts["n"] // 64))))
    dealt = good.withColumn("__h", F.xxhash64("id", "v"))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["dims", "q_block", "c_block"]
    queries = dealt.filter(is_query).select("id", "v", F.size("v").alias("dims"), F.pmod("__h", F.lit(q_blocks)).cast("int").alias("q_block"), blocks(c_blocks).alias("c_block"))
    rows = dealt.select("id", "v", F.size("v").alias("dims"), blocks(q_blocks).alias("q_block"), F.pmod(F.shiftright("__h", 17), F.lit(c_blocks)).cast("int").alias("c_block"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("id").to_numpy(), np.floor(scale * flat).reshape(table.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        made = block_best(*matrix(left), *matrix(right), k) if left.num_rows and right.num_rows else ([], [], [])
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), made)})

    near = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB's brute force.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
