"""A dictionary of terms beside the postings: what a query's terms stand for is found in it, and only then are postings read.

Near spellings: a term of the dictionary is cut into one segment more than edits are allowed, so one segment at least
stands unchanged in the query's term, moved by no more places than there are edits. Segments are stored by their text;
a query looks up the few that its term may hold, and only terms found so are compared. Beginnings are found in the
dictionary's order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.functions.text import snippet_of
from loquent.sources.scratch import written

#: Parameters of BM25+, and the weights of a term found by prefix or near spelling; public defaults of small engines.
K, B, DELTA = 1.2, 0.7, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45
#: The share of a term's length that may be edited, the most edits, and the least length of terms with any.
FUZZY, MOST_EDITS, LEAST_LENGTH = 0.2, 6, 4
#: Length from which all terms are alike in the edits that lead to them.
LONG = 40
#: Terms found up to which the scan of the postings is given their list, and up to which they are broadcast.
LISTED, BROADCAST_ROWS = 1000, 100_000
#: Terms of a query up to which those found are told apart by the bits of a number.
BITS = 62


def edits(length: int, fuzzy: float = FUZZY) -> int:
    return min(MOST_EDITS, round(length * fuzzy)) if length >= LEAST_LENGTH else 0


@dataclass(frozen=True)
class Dictionary:
    """words: term, start (two letters), docs, fields (field, df); in order of term. segments: key, term; in order of key."""

    words: DataFrame
    segments: DataFrame


def words_of(postings: DataFrame) -> DataFrame:
    """One row a term: in how many documents and in how many of each field; postings: id, field, term, and ``first`` if it is known."""
    if "first" in postings.columns:  # one pass, combined before the shuffle
        per = postings.groupBy("term", "field").agg(F.count("*").alias("df"), F.count_if("first").alias("__n"))
        made = per.groupBy("term").agg(F.collect_list(F.struct("field", "df")).alias("fields"), F.sum("__n").alias("docs"))  # a row a field
    else:
        per = postings.groupBy("term", "field").agg(F.count("*").alias("df"))
        fields = per.groupBy("term").agg(F.collect_list(F.struct("field", "df")).alias("fields"))
        made = fields.join(postings.groupBy("term").agg(F.count_distinct("id").alias("docs")), "term")
    made = made.select("term", F.left("term", F.lit(2)).alias("start"), "docs", "fields")
    return made.repartitionByRange("term").sortWithinPartitions("term")


def _cut(size: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Begin (from 0) and length of segment ``i`` of a term of ``size`` letters in ``parts`` segments, the longer ones last."""
    base, longer = F.floor(size / parts), size % parts
    over = F.greatest(F.lit(0), i - (parts - longer))
    return (i * base + over).cast("int"), (base + (i >= parts - longer).cast("int")).cast("int")


def _key(d: Column, size: Column, i: Column, text: Column) -> Column:
    return F.concat_ws(":", d.cast("string"), size.cast("string"), i.cast("string"), text)


def segments_of(words: DataFrame) -> DataFrame:
    """Segments of each term, for each number of edits with which a query may come to a term of its length."""
    reached = [sorted({edits(n) for n in range(LEAST_LENGTH, 2 * LONG) if edits(n) and abs(n - size) <= edits(n)}) for size in range(LONG + 1)]
    allowed = F.element_at(F.array(*[F.array(*[F.lit(d) for d in ds]) if ds else F.array().cast("array<int>") for ds in reached]), F.least(F.length("term"), F.lit(LONG)) + 1)
    size = F.length("term")
    one = lambda d, i: _key(d, size, i, F.substring(F.col("term"), _cut(size, d + 1, i)[0] + 1, _cut(size, d + 1, i)[1]))
    keys = F.flatten(F.transform(allowed, lambda d: F.transform(F.sequence(F.lit(0), d), lambda i: one(d, i))))
    return words.select(F.explode(keys).alias("key"), "term").hint("rebalance", "key").sortWithinPartitions("key")


def probe_keys(term: Column, d: Column) -> Column:
    """The keys of all segments that terms within ``d`` edits may share with ``term``."""
    own = F.length(term)

    def places(size: Column, i: Column) -> Column:
        begin, n = _cut(size, d + 1, i)
        first, last = F.greatest(F.lit(0), begin - d), F.least(own - n, begin + d)
        at = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda x: _key(d, size, i, F.substring(term, x + 1, n)))

    sizes = F.sequence(F.greatest(F.lit(1), own - d), own + d)
    return F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(F.sequence(F.lit(0), d), lambda i: places(size, i)))))


def _counted(df: DataFrame) -> DataFrame:
    """``df``, written and counted: what few queries ask goes to the index, which then isn't shuffled however large it is."""
    held = written(df)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, asked, place, terms (how many) for each distinct term of two letters or more; queries: query_id, q."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("q"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 1))
    held = queries.select("query_id", words.alias("__w"))
    return held.select("query_id", F.size("__w").alias("terms"), F.posexplode("__w").alias("place", "asked"))


def expand(book: Dictionary, queries: DataFrame, fuzzy: bool = True, prefix: bool = True) -> DataFrame:
    """query_id, terms, asked, place, term, weight, docs, fields: the terms of the dictionary that each query's terms stand for.

    A term found in several ways counts as itself, then by prefix (of a query's last term), then by near spelling.
    """
    asked = _counted(asked_terms(queries))
    kept = ["query_id", "terms", "asked", "place"]
    exact = asked.join(book.words, asked["asked"] == book.words["term"]).select(*kept, "term", "docs", "fields", F.lit(1.0).alias("weight"), F.lit(0).alias("way"))
    found = exact
    if prefix:
        last = asked.filter(F.col("place") == F.col("terms") - 1).withColumn("start", F.left("asked", F.lit(2)))
        starts = [r["start"] for r in last.select("start").distinct().limit(LISTED + 1).collect()]
        words = book.words.filter(F.col("start").isin(starts)) if len(starts) <= LISTED else book.words
        last = F.broadcast(last) if len(starts) <= LISTED and last.count() <= BROADCAST_ROWS else last
        more = last.join(words, "start").filter(F.col("term").startswith(F.col("asked")) & (F.col("term") != F.col("asked")))
        extra = F.length("term") - F.length("asked")
        found = found.unionByName(more.select(*kept, "term", "docs", "fields", (PREFIX_WEIGHT * F.length("term") / (F.length("term") + 0.3 * extra)).alias("weight"), F.lit(1).alias("way")))
    if fuzzy:
        most = F.element_at(F.array(*[F.lit(edits(n)) for n in range(2 * LONG)]), F.least(F.length("asked"), F.lit(2 * LONG - 1)) + 1)
        probes = asked.withColumn("d", most).filter("d > 0").select(*kept, "d", F.explode(probe_keys(F.col("asked"), F.col("d"))).alias("key"))
        near = _counted(probes).join(book.segments, "key").select(*kept, "d", "term")
        gap = F.levenshtein("asked", "term")
        near = near.withColumn("gap", gap).filter((F.col("gap") > 0) & (F.col("gap") <= F.col("d"))).distinct()
        near = _counted(near).join(book.words, "term")
        found = found.unionByName(near.select(*kept, "term", "docs", "fields", (FUZZY_WEIGHT * F.length("term") / (F.length("term") + F.col("gap"))).alias("weight"), F.lit(2).alias("way")))
    best = found.groupBy("query_id", "asked", "term").agg(F.min_by(F.struct("terms", "place", "weight", "docs", "fields"), "way").alias("x"))
    return best.select("query_id", "asked", "term", "x.*")


def read_postings(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of the terms found; few terms reach the scan as a list, more than can be broadcast are shuffled."""
    names = written(found.select("term").distinct())
    n = names.count()
    if n <= LISTED:
        return postings.filter(F.col("term").isin([r["term"] for r in names.collect()]))
    return postings.join(F.broadcast(names) if n <= BROADCAST_ROWS else names, "term", "left_semi")


def matches_each(book: Dictionary, postings: DataFrame, sizes: DataFrame, queries: DataFrame, boosts: dict[str, float], fuzzy: bool = True, prefix: bool = True, fields: Sequence[str] | None = None, within: DataFrame | None = None) -> DataFrame:
    """query_id, id, field, term, asked, terms and the score of each posting that a query (query_id, q) finds.

    ``bit``: a bit of a number for each of a query's terms, if no query has more than ``BITS`` of them.

    ``fields``: the ones to search; ``within``: the ids (column id) that may be found, such as an owner's.
    """
    found = _counted(expand(book, queries, fuzzy, prefix))
    read = read_postings(postings, found)
    if fields is not None:
        read = read.filter(F.col("field").isin(list(fields)))
    if within is not None:
        read = read.join(within.select("id").distinct(), "id", "left_semi")
    rows = read.join(found, "term").join(F.broadcast(sizes), "field")  # sizes: a row a field
    df = F.aggregate("fields", F.lit(0).cast("long"), lambda t, x: t + F.when(x["field"] == F.col("field"), x["df"]).otherwise(0))
    idf = F.log(1 + (F.col("docs_in") - df + 0.5) / (df + 0.5))
    tf = F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("length") / F.col("mean")))
    boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field")), F.lit(1.0)) if boosts else F.lit(1.0)
    few = (found.agg(F.max("terms")).first()[0] or 0) <= BITS
    bit = [F.expr("shiftleft(1L, place)").alias("bit")] if few else []
    return rows.select("query_id", "id", "field", "term", "asked", "terms", *bit, (F.col("weight") * boost * idf * (DELTA + tf)).alias("score"))


def search_each(matches: DataFrame, every: bool = True, limit: int = 50) -> DataFrame:
    """query_id, id, score and rank of each query's ``limit`` best; with ``every``, of those that match all its terms."""
    distinct = F.bit_count(F.bit_or("bit")) if "bit" in matches.columns else F.count_distinct("asked")  # bits need one shuffle, and a number a row
    per = matches.groupBy("query_id", "id").agg(F.sum("score").alias("score"), distinct.alias("__n"), F.max("terms").alias("__t"))
    if every:
        per = per.filter(F.col("__n") == F.col("__t"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))  # sums of equal parts may differ in the last place
    return per.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def suggest_each(book: Dictionary, queries: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, suggestion, n and rank: terms that a query's last one may become, by documents and weight; no postings are read."""
    last = asked_terms(queries).filter(F.col("place") == F.col("terms") - 1)
    found = expand(book, last.select("query_id", F.col("asked").alias("q")))
    value = F.round(F.col("docs") * F.col("weight"), 9)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(value), "term"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", F.col("term").alias("suggestion"), F.col("docs").alias("n"), "rank")


def field_snippets(hits: DataFrame, matches: DataFrame, docs: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """query_id, id, field and a snippet for each field of a hit in which terms were found, around the first of them."""
    kept = _counted(hits.select("query_id", "id"))
    terms = _counted(matches.join(kept, ["query_id", "id"], "left_semi").groupBy("query_id", "id", "field").agg(F.collect_set("term").alias("__terms")))
    texts = docs.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("__text")) for f in fields])).alias("x")).select("id", "x.*")
    return terms.join(texts, ["id", "field"]).select("query_id", "id", "field", snippet_of(F.coalesce("__text", F.lit("")), F.col("__terms")).alias("snippet"))
