"""Pairs of similar sets by prefixes in order of frequency: rare members meet, common ones hardly ever.

Two sets of Jaccard index ``least`` or more share one of their rarest members: of a set of n, one of the
n - ceil(least * n) + 1 that are rarest overall. So only these meet, in sets whose sizes allow the index, and a member
that all sets have, such as a greeting, lies in no prefix of a larger set. Equal sets count as one class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.operators.ordering import numbered
from loquent.sources.scratch import written

#: Taken off before rounding up, for the rounding of products.
EPSILON = 1e-9


def classes(rows: DataFrame, key: str, member: str, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sets (rep, scope, member) of one key of each class of equal sets, and the classes: key, rep, size and scope.

    Sets are equal where their size and two sums of 64-bit hashes of their members are; rep is the least key.
    """
    sets = written(rows.filter(F.col(key).isNotNull() & F.col(member).isNotNull()).select(key, member, *scope).distinct())
    one, two = F.xxhash64(member).cast("decimal(38,0)"), F.xxhash64(F.lit(1), member).cast("decimal(38,0)")
    marks = sets.groupBy(key, *scope).agg(F.count("*").alias("size"), F.sum(one).alias("__one"), F.sum(two).alias("__two"))
    alike = [*scope, "size", "__one", "__two"]
    least = marks.groupBy(*alike).agg(F.min(key).alias("rep"))
    named = written(_null_safe(marks, least, alike).select(key, "rep", "size", *scope))
    reps = named.filter(F.col(key) == F.col("rep")).select("rep", *scope)
    of_rep = sets.withColumnRenamed(key, "rep")
    return written(_null_safe(of_rep, reps, ["rep", *scope], "left_semi").select("rep", member, *scope)), named


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of which some may be null, which match then."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [left[c].eqNullSafe(other[f"__r_{c}"]) for c in on]
    return left.join(other, cond, how).drop(*[f"__r_{c}" for c in on])


def prefixes(sets: DataFrame, named: DataFrame, member: str, scope: list[str], least: float) -> DataFrame:
    """The rarest members of each set that one of a similar set must be among: rep, size, member, scope."""
    spread = sets.groupBy(member, *scope).agg(F.count("*").alias("__df"))
    sizes = named.filter(F.col("rep") == F.col(named.columns[0])).select("rep", "size", *scope)
    both = _null_safe(_null_safe(sets, spread, [member, *scope]), sizes, ["rep", *scope])
    scoped = both.withColumn("__scope", F.xxhash64(*[F.col(c) for c in scope]) if scope else F.lit(0).cast("long"))
    placed = numbered(scoped, ["rep", "__scope"], ["__df", member], "__nth")
    enough = F.col("size") - F.ceil(least * F.col("size") - EPSILON) + 1
    # a member of one set alone meets nothing
    return placed.filter((F.col("__nth") < enough) & (F.col("__df") > 1)).select("rep", "size", member, *scope)


def candidates(front: DataFrame, member: str, scope: list[str], least: float) -> DataFrame:
    """Pairs of classes (a, b: the smaller set first, ties by key) that share a member of both prefixes and whose sizes fit."""
    left = front.select(F.col("rep").alias("a"), F.col("size").alias("__na"), member, *scope)
    right = front.select(F.col("rep").alias("b"), F.col("size").alias("__nb"), F.col(member).alias("__m"), *[F.col(c).alias(f"__r_{c}") for c in scope])
    same = (F.col(member) == F.col("__m")) & (F.col("__nb") >= F.col("__na")) & (F.col("__na") >= least * F.col("__nb") - EPSILON)
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    first = (F.col("__na") < F.col("__nb")) | (F.col("a") < F.col("b"))
    return left.join(right, same & first).select("a", "b", "__na", "__nb", *scope).distinct()


def class_pairs(sets: DataFrame, named: DataFrame, member: str, scope: list[str], least: float) -> DataFrame:
    """Pairs of different classes with a Jaccard index of ``least`` or more: a, b, scope, shared, jaccard."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    pairs = written(candidates(written(prefixes(sets, named, member, scope, least)), member, scope, least))
    one = _null_safe(pairs, sets.withColumnRenamed("rep", "a"), ["a", *scope])
    shared = _null_safe(one, sets.withColumnRenamed("rep", "b"), ["b", member, *scope]).groupBy("a", "b", "__na", "__nb", *scope).agg(F.count("*").alias("shared"))
    index = F.col("shared") / (F.col("__na") + F.col("__nb") - F.col("shared"))
    return shared.withColumn("jaccard", index).filter(F.col("jaccard") >= least).select("a", "b", *scope, "shared", "jaccard")


def similar_sets(rows: DataFrame, key: str, member: str, scope: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of equal sets, and the membership of every key (key, rep, size, scope): the answer without copies spelt out."""
    sets, named = classes(rows, key, member, scope)
    return class_pairs(sets, named, member, scope, least), named


def similar_keys(rows: DataFrame, key: str, member: str, scope: list[str], least: float) -> DataFrame:
    """Pairs of keys a < b of one scope whose sets have a Jaccard index of ``least`` or more: a, b, scope, shared, jaccard.

    Rows with a null key or member don't count; a null in ``scope`` is a value like others. Copies are joined last, so what
    meets before grows with the sets and the answer.
    """
    pairs, named = similar_sets(rows, key, member, scope, least)
    own = lambda c: named.select(F.col("rep").alias(c), F.col(key).alias(f"__{c}"), *scope)
    across = _null_safe(_null_safe(pairs, own("a"), ["a", *scope]), own("b"), ["b", *scope])
    across = across.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"), *scope, "shared", "jaccard")
    first = named.select("rep", F.col(key).alias("a"), "size", *scope)
    inside = _null_safe(first, named.select("rep", F.col(key).alias("b"), *scope), ["rep", *scope]).filter("a < b")
    return across.unionByName(inside.select("a", "b", *scope, F.col("size").alias("shared"), F.lit(1.0).alias("jaccard")))
