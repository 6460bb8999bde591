"""Fielded full-text search for one query: BM25+ with boosts, prefixes and near spellings, over ``terms``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquent.functions.text import snippet_around
from loquent.operators import terms
from loquent.operators.terms import Dictionary


def _counted(words: Column) -> Column:
    """term and tf for each distinct word of an array in order: words are sorted, and each run of equal ones counted."""
    runs = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    held = F.transform(F.array(F.array_sort(words)), lambda w: F.struct(w.alias("w"), runs(w).alias("at")))
    each = lambda s: F.transform(s["at"], lambda i, n: F.struct(F.get(s["w"], i).alias("term"), (F.coalesce(F.get(s["at"], n + 1), F.size(s["w"])) - i).cast("long").alias("tf")))
    return F.when(F.size(words) > 0, F.get(F.transform(held, each), F.lit(0)))


def index(docs: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """id, field, term, tf and the field's length; terms are in lower case and longer than one character.

    In order of term, so that a stored index is read only where its terms may lie. Where no id is repeated, terms are
    counted in their row and shuffled once, ``first`` marks a term's first field in a document and ``head`` one term of each
    field, from which documents are counted without a shuffle; else equal rows of one id are added up, without these.
    """
    ids = docs.select(F.col(key).alias("id"))
    found = [F.filter(F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 1).alias(f"__{i}") for i, f in enumerate(fields)]
    # lists of words are made in one step and used in the next, so each text is read once
    lists = docs.select(F.col(key).alias("id"), *found)
    before = [None] * len(fields)
    for i in range(1, len(fields)):
        before[i] = F.col("__0") if i == 1 else F.concat(*[F.col(f"__{j}") for j in range(i)])
    seen = lambda i: F.array_intersect(F.col(f"__{i}"), before[i]) if i else F.array().cast("array<string>")
    one = lambda i: F.struct(F.lit(fields[i]).alias("field"), F.size(f"__{i}").alias("length"), _counted(F.col(f"__{i}")).alias("terms"), seen(i).alias("seen"))
    parts = lists.select("id", F.explode(F.array(*[one(i) for i in range(len(fields))])).alias("x")).select("id", "x.*")
    rows = parts.select("id", "field", "length", "seen", F.posexplode("terms").alias("nth", "t"))
    rows = rows.select("id", "field", "length", "t.term", "t.tf", (~F.array_contains("seen", F.col("t.term"))).alias("first"), (F.col("nth") == 0).alias("head"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        rows = rows.groupBy("id", "field", "length", "term").agg(F.sum("tf").alias("tf"))
    return rows.hint("rebalance", "term").sortWithinPartitions("term", "id")


def field_sizes(postings: DataFrame) -> DataFrame:
    """Per field how many documents have it and its mean length: facts of the index, stored beside it."""
    each = postings.filter("head") if "head" in postings.columns else postings.select("id", "field", "length").distinct()
    return each.groupBy("field").agg(F.count("*").alias("docs_in"), F.avg("length").alias("mean"))


def query_terms(q: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.findall(r"\w+", q.lower()) if len(t) > 1))


def dictionary(postings: DataFrame) -> Dictionary:
    """The dictionary of a table of postings; worth storing where it is read more than once."""
    words = terms.words_of(postings)
    return Dictionary(words, terms.segments_of(words))


def _one(postings: DataFrame, q: str) -> DataFrame:
    return postings.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(q).alias("q"))


def search(postings: DataFrame, q: str, boosts: dict[str, float], fuzzy: bool = True, prefix: bool = True, every: bool = True, limit: int = 50, sizes: DataFrame | None = None, book: Dictionary | None = None) -> DataFrame:
    """id and score; with ``every``, of those that match each term of the query. ``sizes``, ``book``: stored ones."""
    sizes = field_sizes(postings) if sizes is None else sizes
    found = terms.matches_each(book or dictionary(postings), postings, sizes, _one(postings, q), boosts, fuzzy, prefix)
    return terms.search_each(found, every, limit).orderBy("rank").select("id", "score")


def with_snippets(hits: DataFrame, docs: DataFrame, q: str, text: str, key: str = "id") -> DataFrame:
    """``hits`` (id, score), few enough to broadcast, with the place in a field where a term of the query first stands."""
    rows = docs.select(F.col(key).alias("id"), snippet_around(F.coalesce(text, F.lit("")), query_terms(q)).alias("snippet"))
    return rows.join(F.broadcast(hits), "id").select(*hits.columns, "snippet")


def suggest(postings: DataFrame, q: str, limit: int = 8, book: Dictionary | None = None) -> DataFrame:
    """Terms of the index that the last word of the query may become, by how many documents have them."""
    return terms.suggest_each(book or dictionary(postings), _one(postings, q), limit).orderBy("rank").select("suggestion", "n")
