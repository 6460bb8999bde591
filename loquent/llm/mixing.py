"""Mixing sources to target weights, with DataFrame functions alone.

Tokens are summed per source; a source's repetition rate is its target over its size; a document is emitted
floor(rate) times, plus once more if a draw seeded by a hash of its id falls below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquent.llm.common import WORD, join_small, materialize, running_totals


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size``: the words of the text, 0 for null."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, source: str = "source", weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: its key, ``source_size`` and ``target``.

    Sources by code point, null last, take the weights in turn. The targets share the whole of all sizes by
    weight; one that would exceed ``cap`` times its source's size stops there, and what it leaves is shared by
    weight among the rest. With sources ordered by cap over weight those that stop come first, so one pass of
    running totals finds the level at which the rest share. Empty input gives no rows; sources without words
    get the target 0.
    """
    per = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    ranked = running_totals(per, [F.col(source).asc_nulls_last()], {"__rank": F.lit(1).cast("long")})
    turn = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = ranked.withColumn("__weight", F.get(turn, F.pmod("__rank", F.lit(len(weights))).cast("int")))
    ranked = ranked.withColumn("__ceiling", F.col("source_size") * cap)
    order = [(F.col("__ceiling").cast("double") / F.col("__weight")).asc(), F.col("__rank").asc()]
    filled = materialize(running_totals(ranked, order, {"__full": F.col("__ceiling"), "__gone": F.col("__weight")}))
    total = filled.agg(F.sum("source_size").alias("__all"), F.sum("__weight").alias("__weights"))
    level = (F.col("__all") - F.col("__full")).cast("double") / (F.col("__weights") - F.col("__gone")).cast("double")
    levels = filled.join(F.broadcast(total)).agg(F.max(level).alias("__level"))  # one row
    share = F.col("__level") * F.col("__weight")
    target = F.least(F.col("__ceiling").cast("double"), share)
    return filled.join(F.broadcast(levels)).select(source, "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 20) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, the times the mix takes it.

    Nulls: a null text has size 0, a null source is a source of its own, a null id draws as the text "null".
    Rows that repeat an id draw alike. Input columns named as a result column are replaced. No rows give none.
    Documents of a source without words have 0 copies. Reruns agree, as draws depend on id and seed only. Texts of any
    length are counted whole.
    """
    made = ("size", "source_size", "target", "copies")
    docs = docs.drop(*[c for c in made if c not in (id_col, source, text)])
    sized = with_sizes(docs, text)
    targets = materialize(source_targets(sized.select(source, "size"), source, weights, cap))
    joined = join_small(sized, targets, source, targets.count(), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("int"))


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """One row per copy, numbered from 0 in ``copy``; documents with 0 copies go."""
    numbers = F.when(F.col(copies) > 0, F.sequence(F.lit(0), F.col(copies) - 1)).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn("copy", F.explode(numbers)).drop(copies)


#: DuckDB's form of the query, on the view documents; {docs} names the rows.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM per),
weighed AS (SELECT *, rnk % 3 + 1 AS w, 3 * source_size AS ceiling FROM ranked),
filled AS (
  SELECT *, coalesce(sum(ceiling) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS gone,
    sum(source_size) OVER () AS everything, sum(w) OVER () AS weights
  FROM weighed WINDOW o AS (ORDER BY ceiling::DOUBLE / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT max((everything - full_before)::DOUBLE / (weights - gone)::DOUBLE) AS lvl FROM filled),
targets AS (SELECT source, source_size, least(ceiling::DOUBLE, lvl * w) AS target FROM filled, levels),
rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('20:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""
