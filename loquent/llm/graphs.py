"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, searched by beams.

Shards are built in batches: a greedy search over the graph so far proposes neighbours of each new node; of those, in
order of distance, one is kept and all go that are nearer to it, by a factor, than to the node; edges back are added and
pruned alike. The graph is written as a table. A query walks each shard's graph with a beam and takes the nearest it saw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquent.llm.common import join_small, materialize
from loquent.llm.topk import usable

#: Edges of a node, width of the beam in building and in search, and the factor of the pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 96, 1.2
#: Searches that run side by side, and nodes whose edges each of them follows in a step.
TOGETHER, STEP = 512, 4


def unit_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and rows scaled by a power of two so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(rows).max(1, keepdims=True, initial=0))
    scaled = np.ldexp(rows, -exponent)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True)), scaled


def beam(x: np.ndarray, graph: np.ndarray, start: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row asked, ``width`` nodes near it, nearest first, and their inner products; -1 and -inf where fewer.

    All searches go on side by side: each follows the edges of the nearest nodes of its beam that it hasn't followed yet.
    """
    n = len(asked)
    ids = np.full((n, width), -1, np.int32)
    near = np.full((n, width), -np.inf, np.float32)
    spent = np.zeros((n, width), bool)
    first = start[:width]
    ids[:, : len(first)] = first
    near[:, : len(first)] = asked @ x[first].T
    seen = np.zeros((n, len(x) + 1), bool)  # the last place stands for no node
    seen[:, first] = True
    seen[:, -1] = True
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    live = np.arange(n)
    while len(live):
        fresh = ~spent[live] & (ids[live] >= 0)
        rank = np.cumsum(fresh, axis=1)
        chosen = fresh & (rank <= STEP)
        live = live[chosen.any(1)]
        if not len(live):
            break
        chosen = chosen[chosen.any(1)]
        spent[live] |= chosen
        places = np.argsort(~chosen, axis=1, kind="stable")[:, :STEP]
        nodes = np.where(np.take_along_axis(chosen, places, 1), np.take_along_axis(ids[live], places, 1), -1)
        new = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        found = np.where(new >= 0, np.matmul(x[new], asked[live][:, :, None])[:, :, 0], -np.inf)
        all_near = np.concatenate([near[live], found], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_near, best, 1), axis=1, kind="stable"), 1)
        near[live] = np.take_along_axis(all_near, best, 1)
        ids[live] = np.where(np.isfinite(near[live]), np.take_along_axis(np.concatenate([ids[live], new], axis=1), best, 1), -1)
        spent[live] = np.take_along_axis(np.concatenate([spent[live], np.zeros(new.shape, bool)], axis=1), best, 1)
    return ids, near


def pruned(x: np.ndarray, nodes: np.ndarray, offered: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` of the neighbours offered to each node (-1: none), by relaxed distance pruning."""
    far = np.where(offered >= 0, 2 - 2 * np.matmul(x[offered], x[nodes][:, :, None])[:, :, 0], np.inf)
    far[offered == nodes[:, None]] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    offered, far = np.take_along_axis(offered, order, 1), np.take_along_axis(far, order, 1)
    far[:, 1:][offered[:, 1:] == offered[:, :-1]] = np.inf  # one that is offered twice lies beside itself
    vectors = x[offered]
    apart = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    left = np.isfinite(far)
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = left.argmax(1)
        some = left[rows, first]
        if not some.any():
            break
        out[some, k] = offered[rows, first][some]
        left &= ~((alpha * alpha * apart[rows, first] <= far) & some[:, None])
        left[rows, first] = False
    return out


def built(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each node (-1: none) and where searches start; rows of ``x`` have length 1 and come in any fixed order."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    start = np.array([int((x @ x.mean(0)).argmax())], np.int32) if n else np.zeros(0, np.int32)
    order = np.concatenate([start, np.delete(np.arange(n, dtype=np.int32), start)])
    done = 1
    while done < n:
        batch = order[done : done + min(TOGETHER, max(16, done))]
        if done <= width:
            offered = np.broadcast_to(order[: done + len(batch)], (len(batch), done + len(batch))).copy()
        else:
            offered = beam(x, graph, start, x[batch], width)[0]
        graph[batch] = pruned(x, batch, offered, degree, alpha)
        _add_back(x, graph, batch, degree, alpha)
        done += len(batch)
    return graph, start


def _add_back(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Adds an edge back for each edge of the batch; nodes that then have too many are pruned."""
    to = graph[batch]
    own, other = np.nonzero(to >= 0)
    source, target = batch[own], to[own, other]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(nodes), TOGETHER):
        some, n_new = nodes[at : at + TOGETHER], count[at : at + TOGETHER]
        new = np.full((len(some), int(n_new.max())), -1, np.int32)
        for i, (b, c) in enumerate(zip(begin[at : at + TOGETHER], n_new)):
            new[i, :c] = source[b : b + c]
        both = np.concatenate([graph[some], new], axis=1)
        full = (both >= 0).sum(1) > degree
        keep = np.argsort(both < 0, axis=1, kind="stable")[:, :degree]
        graph[some] = np.take_along_axis(both, keep, 1)
        if full.any():
            crowded = both[full]
            for part in range(0, len(crowded), max(1, 64 * TOGETHER // crowded.shape[1])):
                rows = slice(part, part + max(1, 64 * TOGETHER // crowded.shape[1]))
                graph[some[full][rows]] = pruned(x, some[full][rows], crowded[rows], degree, alpha)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def sound(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    return usable(vectors, id_col, vector).filter(F.exists("v", lambda x: x != 0)).withColumn("dims", F.size("v"))


def index(vectors: DataFrame, keep: int = 6, shard_rows: int = 8192, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The graph: dims, shard, slot, v, members, edges (slots), start; a row for each distinct vector, every one of them.

    Equal vectors are one node, whose ``keep`` smallest ids are its members. Nodes are dealt by hash into shards of about
    ``shard_rows``, each built in one task.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = sound(vectors, id_col, vector).withColumn("nth", nth).filter(F.col("nth") <= keep)
    nodes = materialize(nodes.groupBy("dims", "v").agg(F.sort_array(F.collect_list("id")).alias("members")))
    sizes = nodes.groupBy("dims").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = join_small(nodes, sizes, "dims", sizes.count()).withColumn("h", F.xxhash64("v"))
    dealt = dealt.select("dims", F.pmod("h", "shards").cast("int").alias("shard"), "h", "v", "members")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending")])
        x = unit_rows(_matrix(table.column("v"), table.column("dims")[0].as_py()))[0].astype(np.float32)
        graph, start = built(x)
        first = np.zeros(len(x), bool)
        first[start] = True
        edges = pa.array([g[g >= 0] for g in graph], pa.list_(pa.int32()))
        return table.drop_columns(["h"]).append_column("slot", pa.array(np.arange(len(x)), pa.int32())).append_column("edges", edges).append_column("start", pa.array(first))

    return dealt.groupBy("dims", "shard").applyInArrow(build, "dims int, shard int, v array<double>, members array<bigint>, slot int, edges array<int>, start boolean")


def search(graph: DataFrame, queries: DataFrame, k: int = 5, width: int = BEAM, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id and score, the cosine: the ``k`` nearest found for each query (id, v, dims), itself left out.

    Blocks of queries meet every shard of their length; each sends on ``k + 1`` nodes a query, whose members then stand
    for themselves: the query's own vector may be one of them.
    """
    shards = graph.select("dims", "shard").distinct()
    n_blocks = max(1, -(-queries.count() // query_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")
    asked = queries.select("id", "v", "dims", block).join(shards, "dims").select("dims", "shard", "block", "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    rows = graph.select("dims", "shard", "slot", "v", "members", "edges", "start", every)
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "members": pa.array([], pa.list_(pa.int64()))})
        if not left.num_rows or not right.num_rows:
            return none
        dims = left.column("dims")[0].as_py()
        right = right.sort_by([("slot", "ascending")])
        units, scaled = unit_rows(_matrix(right.column("v"), dims))
        x = units.astype(np.float32)
        lists = right.column("edges").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        graph_ = np.full((len(x), max(1, count.max(initial=0))), -1, np.int32)
        graph_[np.repeat(np.arange(len(x)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = lists.flatten().to_numpy()
        start = np.flatnonzero(right.column("start").to_numpy()).astype(np.int32)
        q_units, q_scaled = unit_rows(_matrix(left.column("v"), dims))
        ids, size = left.column("id").to_numpy(), np.sqrt((scaled * scaled).sum(1))
        made = []
        for at in range(0, len(ids), TOGETHER):
            some = slice(at, at + TOGETHER)
            found = beam(x, graph_, start, q_units[some].astype(np.float32), max(width, k + 1))[0]
            i, j = np.nonzero(found >= 0)
            node = found[i, j]
            i = i + at
            score = (q_scaled[i] * scaled[node]).sum(1) / (np.sqrt((q_scaled[i] * q_scaled[i]).sum(1)) * size[node])
            order = np.lexsort((node, -score, i))
            i, node, score = i[order], node[order], score[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            nth = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))
            least = np.full(len(ids), np.inf)  # the score of place k + 1: what ties with it goes along
            np.minimum.at(least, i[nth <= k], score[nth <= k])
            stay = score >= least[i]
            made.append(pa.table({"id": ids[i[stay]], "score": score[stay], "members": right.column("members").combine_chunks().take(pa.array(node[stay]))}))
        return pa.concat_tables(made) if made else none

    keys = ["dims", "shard", "block"]
    near = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, "id bigint, score double, members array<bigint>")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.col("members")[0]))
    near = near.withColumn("rank", best).filter(F.col("rank") <= k + 1)
    each = near.select(F.col("id").alias("query_id"), "score", F.explode("members").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = 8192, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: the ``k`` other rows found nearest by cosine, with the exact cosine.

    Rows with a null id, a null or zero vector or a null or non-finite component take no part; vectors meet only those of
    equal length; fewer than ``k`` others give that many rows; ties go to the smaller id. Rows with the query's id aren't
    candidates for it, of rows that repeat it the least vector asks, and rows that repeat another id are candidates
    each. Equal vectors are one node of the graph, so copies in any number are all found. No rows give none; other
    columns don't matter.
    """
    graph = materialize(index(vectors, k + 1, shard_rows, id_col, vector))
    asked = sound(vectors, id_col, vector).filter(F.pmod(F.col("id"), F.lit(every)) == 0)
    queries = materialize(asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")))
    return search(graph, queries, k)
