"""Facets, tags and browsing of a catalog of documents or cards."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.functions.values import jaccard


def facets(items: DataFrame, played: DataFrame, facet: str, key: str) -> DataFrame:
    """Per value of a facet: items, and how many rows of ``played`` they have together; null values are left out."""
    per = played.groupBy(key).agg(F.count("*").alias("__n"))
    joined = items.filter(F.col(facet).isNotNull()).join(per, key, "left")
    return joined.groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("collected"), F.sum(F.coalesce("__n", F.lit(0))).alias("played"))


def tag_rows(items: DataFrame, key: str, tags: str) -> DataFrame:
    """key and tag, in lower case, each once."""
    return items.select(key, F.explode(tags).alias("tag")).select(key, F.lower(F.trim("tag")).alias("tag")).filter(F.col("tag") != "").distinct()


def top_tags(rows: DataFrame, limit: int = 40) -> DataFrame:
    return rows.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def tag_pairs(items: DataFrame, tags: str, least: int = 2, limit: int = 30) -> DataFrame:
    """Pairs of tags of one item, made inside the row, with the number of items that have both.

    ``tags`` must be short lists: a row makes as many pairs as its list has.
    """
    clean = F.array_sort(F.array_distinct(F.transform(tags, lambda x: F.lower(F.trim(x)))))
    pairs = F.flatten(F.transform(clean, lambda a: F.transform(F.filter(clean, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = items.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    counted = rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.orderBy(F.desc("n"), "a", "b").limit(limit)


def compare(left: DataFrame, right: DataFrame, tags: str) -> DataFrame:
    """Two one-row tables compared by their sets of tags."""
    a, b = left.select(F.array_distinct(tags).alias("a")), right.select(F.array_distinct(tags).alias("b"))
    both = a.crossJoin(b)  # one row each
    return both.select(
        F.size(F.array_intersect("a", "b")).alias("shared"),
        F.size(F.array_except("a", "b")).alias("only_a"),
        F.size(F.array_except("b", "a")).alias("only_b"),
        jaccard(F.col("a"), F.col("b")).alias("jaccard"),
    )


def suggestions(rows: DataFrame, known: DataFrame, key: str, least: int = 2, length: int = 2) -> DataFrame:
    """Tags that ``known`` lacks, in any case, with the number of items; rows: key and tag."""
    fresh = rows.filter(F.length("tag") >= length).join(known.select(F.lower("tag").alias("tag")).distinct(), "tag", "left_anti")
    return fresh.groupBy("tag").agg(F.count_distinct(key).alias("n")).filter(F.col("n") >= least)


def apply_suggestions(links: DataFrame, wanted: DataFrame, truth: DataFrame) -> DataFrame:
    """``links`` and those of ``wanted`` (key, tag) that hold in ``truth`` and aren't there yet."""
    on = ["key", "tag"]
    new = wanted.select(on).distinct().join(truth.select(on), on, "left_semi").join(links, on, "left_anti")
    return links.select(on).union(new)


def tag_counts(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Every tag with the number of its links, 0 included."""
    per = links.groupBy("tag").agg(F.count("*").alias("n"))
    return tags.join(per, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def browse(items: DataFrame, equal: dict[str, str] | None = None, tag: str | None = None, q: str | None = None, search: tuple[str, ...] = (), order: str = "id", descending: bool = False, limit: int = 200) -> DataFrame:
    """Rows that meet every condition given; ``q`` may stand in any of the ``search`` columns."""
    tests = [F.col(c) == v for c, v in (equal or {}).items()]
    if tag:
        tests.append(F.exists("tags", lambda x: F.lower(x) == tag.lower()))
    if q and q.strip():
        tests.append(reduce(or_, [F.contains(F.lower(F.col(c)), F.lit(q.strip().lower())) for c in search]))
    found = items.filter(reduce(and_, tests)) if tests else items
    return found.orderBy(F.desc(order) if descending else F.asc(order), "id").limit(limit)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """How many children there are, and how many name a parent that isn't there; null keys aren't orphans."""
    keys = parents.select(F.col(parent_key).alias("__key")).distinct()
    lost = children.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__key"), "left_anti").agg(F.count("*").alias("orphans"))
    return children.agg(F.count("*").alias("children")).crossJoin(lost)  # one row each


def fsck(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored files (hash, content) against rows (hash): ok, corrupt, orphan file or dangling row."""
    actual = files.select(F.col("hash").alias("__file"), F.sha2("content", 256).alias("__actual"))
    both = rows.select("hash").distinct().join(actual, F.col("hash") == F.col("__file"), "full_outer")
    state = F.when(F.col("__file").isNull(), "dangling").when(F.col("__actual") != F.col("__file"), "corrupt").when(F.col("hash").isNull(), "orphan").otherwise("ok")
    return both.select(F.coalesce("hash", "__file").alias("hash"), state.alias("state"))
