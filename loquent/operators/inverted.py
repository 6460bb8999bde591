"""An inverted-file index of vectors: cells around centroids, read one after another until an answer is proved.

Centroids come of a bounded sample; every row goes to its nearest one, and cells are folders of Parquet. Between unit
vectors the angle is a distance, so a row of a cell is at least as far from a query as the query is from the centroid,
less the cell's radius. A query reads its nearest cells first, and then just those whose bound its k-th angle doesn't
exclude: what it returns is exact. ``most_cells`` ends it earlier, for an approximate answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.operators.vectors import _unit
from loquent.sources.scratch import written

#: Rows that centroids are fitted on at most, values that these may hold, and cells at most.
SAMPLE_ROWS, SAMPLE_VALUES, MOST_CELLS = 50_000, 8_000_000, 4096
#: Rows of a block of a cell; a larger cell is met block by block.
BLOCK = 4096
#: Rows of a batch that meet all centroids at once: with ``MOST_CELLS`` of them their angles hold 8 MB.
TILE = 256
#: Slack of the bounds, in radians, for rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """What the driver holds of an index: a row a cell (at most ``MOST_CELLS``), and where the rows lie."""

    path: str
    centres: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray


def fitted(vectors: DataFrame, per_cell: int = 128, rounds: int = 8) -> np.ndarray:
    """Unit centroids, one for ``per_cell`` rows, of the rows with the least hashes: at most ``SAMPLE_ROWS`` of them."""
    some = vectors.filter(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0))
    facts = some.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not facts["n"]:
        return np.zeros((0, 0))
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // facts["dims"]))
    sample = some.select(F.xxhash64("id").alias("h"), "id", "vec").orderBy("h", "id").limit(most).toArrow()
    x = _unit(sample)
    centres = x[: max(1, min(MOST_CELLS, facts["n"] // per_cell, len(x)))].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 8 * TILE] @ centres.T).argmax(1) for at in range(0, len(x), 8 * TILE)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def dealt(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, vec, cell and the angle to its centroid, for every row with a vector; rows without length are of cell -1."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                x = _unit(pa.Table.from_batches([batch]))
                angle = _angles(x, centres) if len(centres) else np.zeros((len(x), 1))
                cell, least = angle.argmin(1).astype(np.int32), angle.min(1)
                none = ~x.any(1)
                cell[none], least[none] = -1, 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(least)], ["id", "vec", "cell", "angle"])

    kind = dict(vectors.dtypes)["vec"]
    return vectors.filter(F.col("vec").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(deal, f"id bigint, vec {kind}, cell int, angle double")


def build(vectors: DataFrame, path: str, per_cell: int = 128) -> None:
    """Writes the index of a table (id, vec) under ``path``: centroids, facts of cells, and rows in a folder a cell.

    Rows are dealt to writers by cell; Spark splits a cell that is far larger than others.
    """
    spark = vectors.sparkSession
    centres = fitted(vectors, per_cell)
    rows = dealt(vectors, centres).hint("rebalance", "cell")
    rows.write.partitionBy("cell").parquet(f"{path}/rows", compression="zstd")
    held = _rows(spark, path, dict(vectors.dtypes)["vec"])
    facts = held.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    facts.join(made, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"id bigint, vec {kind}, angle double, cell int").parquet(f"{path}/rows")


def opened(spark: SparkSession, path: str) -> Cells:
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    dims = max((len(r["centre"]) for r in table if r["centre"] is not None), default=1)
    centres = np.array([r["centre"] if r["centre"] is not None else [0.0] * dims for r in table]).reshape(len(table), dims)
    column = lambda name: np.array([r[name] for r in table])
    return Cells(path, centres, column("cell").astype(np.int32), column("low").astype(float), column("high").astype(float), column("rows").astype(np.int64))


def append(vectors: DataFrame, path: str) -> None:
    """Adds rows to an index without fitting it again; the facts of cells are made anew."""
    spark = vectors.sparkSession
    held = spark.read.parquet(f"{path}/cells")
    cells = opened(spark, path)
    named = {int(c): v for c, v in zip(cells.number, cells.centres) if c >= 0}
    order = sorted(named)
    new = dealt(vectors, np.array([named[c] for c in order]))
    back = F.element_at(F.array(*[F.lit(c) for c in order]), F.col("cell") + 1) if order else F.lit(-1)
    new = new.withColumn("cell", F.when(F.col("cell") < 0, -1).otherwise(back))
    new.write.partitionBy("cell").mode("append").parquet(f"{path}/rows", compression="zstd")
    facts = _rows(spark, path, dict(vectors.dtypes)["vec"]).groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    centres = written(held.select("cell", "centre"))
    facts.join(centres, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def bounds(x: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """For queries of length 1 (or 0) and each cell: the angle to its centroid, and the least angle to any row of it."""
    angle = _angles(x, cells.centres)
    least = np.maximum(0, np.maximum(angle - cells.high, cells.low - angle)) - SLACK
    least[:, cells.number < 0] = -1  # rows without length are at a right angle to all
    least[~x.any(1)] = -1
    return angle, least


def probes(queries: DataFrame, cells: Cells, begin: int, end: int | None) -> DataFrame:
    """query_id, vec, cell and reach, for the cells that a query (query_id, vec, reach) must read of those ranked ``begin`` to ``end`` by angle."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                angle, least = bounds(_unit(pa.Table.from_batches([part])), cells)
                rank = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1)
                reach = part.column("reach").to_numpy()[:, None]
                i, j = np.nonzero((rank >= begin) & (rank < (end or angle.shape[1])) & (least <= reach))
                for to in range(0, len(i), 32 * TILE):  # a query may read every cell
                    own = pa.array(i[to : to + 32 * TILE])
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(own), part.column("vec").take(own), pa.array(cells.number[j[to : to + 32 * TILE]]), part.column("reach").take(own)], ["query_id", "vec", "cell", "reach"])

    kind = dict(queries.dtypes)["vec"]
    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), "vec", F.col("reach").cast("double").alias("reach")).mapInArrow(plan, f"query_id bigint, vec {kind}, cell int, reach double")


def _met(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """query_id, id and distance of the ``k`` nearest rows of each cell that a query reads, as far as they are in its reach.

    Only these cells are scanned.
    """
    spark = asked.sparkSession
    read = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
    blocks = {int(c): -(-int(n) // BLOCK) for c, n in zip(cells.number, cells.rows)}
    large = {c: b for c, b in blocks.items() if b > 1 and c in set(read)}
    parts = F.lit(1)
    if large:
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("cell")], F.lit(1))
    rows = _rows(spark, cells.path, dict(asked.dtypes)["vec"]).filter(F.col("cell").isin(read))
    rows = rows.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "vec")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "query_id", "vec", "reach")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        query, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        far = np.zeros(0)
        if left.num_rows and right.num_rows:
            q, ids, x = left.column("query_id").to_numpy(), right.column("id").to_numpy(), _unit(right)
            out = []
            far_off = 1 - np.cos(np.minimum(left.column("reach").to_numpy() + SLACK, np.pi)) + SLACK
            for at in range(0, len(q), TILE):
                d = 1 - _unit(left.slice(at, TILE)) @ x.T
                d[q[at : at + TILE, None] == ids] = np.inf
                n = min(k, d.shape[1])
                last = np.minimum(np.partition(d, n - 1, axis=1)[:, n - 1], far_off[at : at + TILE])
                i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
                out.append((q[at + i], ids[j], d[i, j]))
            query, row, far = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": query, "id": row, "distance": far})

    return asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(meet, "query_id bigint, id bigint, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def nearest_each(cells: Cells, queries: DataFrame, k: int, first: int = 4, most_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``vectors.nearest_each`` through an index: (query_id, id, distance) and the cells that each query read (query_id, cell).

    Three rounds at most: the ``first`` nearest cells, those up to eight times as many, and what is left; each reads
    only cells that the k-th distance so far doesn't rule out, so the last one proves the answer. ``most_cells``: no
    further than so many cells, for an approximate answer.
    """
    spark = queries.sparkSession
    queries = queries.filter(F.col("vec").isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), "vec")
    found = spark.createDataFrame([], "query_id bigint, id bigint, distance double")
    read = spark.createDataFrame([], "query_id bigint, cell int")
    far = F.lit(4.0)  # beyond any angle
    steps = [(0, first), (first, 8 * first), (8 * first, None)]
    for begin, end in steps:
        if begin >= len(cells.number) or (most_cells is not None and begin >= most_cells):
            break
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        reach = F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("kth"))))).otherwise(far)
        now = queries.join(kth, "query_id", "left").select("query_id", "vec", F.coalesce(reach, far).alias("reach"))
        until = end if most_cells is None else min(end or most_cells, most_cells)
        asked = written(probes(now, cells, begin, until))
        if begin and not asked.limit(1).count():
            break
        found = written(_best(found.unionByName(_met(asked, cells, k)), k))
        read = read.unionByName(asked.select("query_id", "cell"))
    return found, read


def shares(cells: Cells, read: DataFrame) -> DataFrame:
    """Per query the share of the cells and of the rows that it read."""
    sizes = read.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(cells.number, cells.rows)], "cell int, rows bigint")
    per = read.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count("*").alias("c"), F.sum("rows").alias("r"))  # at most MOST_CELLS rows
    return per.select("query_id", (F.col("c") / len(cells.number)).alias("cells_read"), (F.col("r") / int(cells.rows.sum())).alias("rows_read"))

