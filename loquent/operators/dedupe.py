"""Exact and overlap-based duplicates, and lineage of forks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.operators.setjoin import similar_keys
from loquent.sources.scratch import written


def collapse(rows: DataFrame, hashed: str, order: str) -> DataFrame:
    """The first row of each hash with ``members``; rows without a hash all stay, as groups of one.

    The first row comes of an aggregate, so that a hash which very many rows share is combined before the shuffle.
    """
    kept = [c for c in rows.columns if c != hashed]
    some = rows.filter(F.col(hashed).isNotNull()).groupBy(hashed).agg(F.min_by(F.struct(*kept), F.col(order)).alias("__row"), F.count("*").alias("members"))
    some = some.select(hashed, "__row.*", "members").select(*rows.columns, "members")
    return some.union(rows.filter(F.col(hashed).isNull()).withColumn("members", F.lit(1).cast("long")))


def fork_roots(chats: DataFrame) -> DataFrame:
    """chat_id and the topmost ancestor of each chat (columns chat_id, parent_id), over any number of generations.

    Pointers double each round, and chats that have reached their top take no further part. Those that are left once
    as many steps are covered as there are such chats lie on a cycle or below one, and end at the least id of it. An
    unknown parent is no parent. Rounds are written to the shared folder; their number is the logarithm of the longest chain.
    """
    known = chats.select(F.col("chat_id").alias("__p")).distinct()
    up = chats.dropDuplicates(["chat_id"]).join(known, F.col("parent_id") == F.col("__p"), "left").select("chat_id", F.coalesce("__p", "chat_id").alias("up"))
    now = written(up.select("chat_id", "up", F.least("chat_id", "up").alias("least"), (F.col("up") == F.col("chat_id")).alias("done")))
    steps = 1
    while (left := now.filter("not done").count()) and steps <= 2 * left:
        above = now.select(F.col("chat_id").alias("__c"), F.col("up").alias("__u"), F.col("least").alias("__l"), F.col("done").alias("__d"))
        moved = now.filter("not done").join(above, F.col("up") == F.col("__c")).select("chat_id", F.col("__u").alias("up"), F.least("least", "__l").alias("least"), F.col("__d").alias("done"))
        now, steps = written(now.filter("done").union(moved)), 2 * steps
    on_cycle = now.select(F.col("chat_id").alias("__c"), F.col("least").alias("__l"))
    return now.join(on_cycle, F.col("up") == F.col("__c")).select("chat_id", F.when(F.col("done"), F.col("up")).otherwise(F.col("__l")).alias("root"))


def chat_duplicates(segments: DataFrame, chats: DataFrame, sizes: DataFrame, least: float = 0.3, over: int = 20) -> DataFrame:
    """Pairs of chats of one owner and model that share blocks of text, each labelled forked or duplicate.

    segments: chat_id, owner_id, model, content_hash; chats: chat_id, parent_id; sizes: chat_id, messages. Only chats
    with more than ``over`` messages count; blocks without a hash don't.
    """
    eligible = segments.join(sizes.filter(F.col("messages") > over).select("chat_id"), "chat_id", "left_semi")
    pairs = similar_keys(eligible, "chat_id", "content_hash", ["owner_id", "model"], least)
    roots = fork_roots(chats)
    side = lambda c: roots.select(F.col("chat_id").alias(c), F.col("root").alias(f"__{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("relation", relation(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def read_duplicates(pairs: DataFrame, least: float = 0.3, include_forked: bool = False, owner: int | None = None, limit: int = 100) -> DataFrame:
    """The likest pairs of stored duplicates (a, b, owner_id, jaccard, relation): of one owner, forks only if asked for."""
    kept = pairs.filter(F.col("jaccard") >= least)
    if not include_forked:
        kept = kept.filter("relation <> 'forked'")
    if owner is not None:
        kept = kept.filter(F.col("owner_id") == owner)
    return kept.orderBy(F.desc(F.round("jaccard", 9)), "a", "b").limit(limit)


def duplicate_counts(vector_pairs: DataFrame, chat_pairs: DataFrame, counted: Column | None = None) -> DataFrame:
    """One row: pairs of look-alike characters, and of duplicate chats, forks left out.

    ``counted``: an aggregate of the first table, where it isn't a row a pair.
    """
    one = vector_pairs.agg((F.count("*") if counted is None else counted).alias("characters"))
    return one.crossJoin(F.broadcast(chat_pairs.filter("relation <> 'forked'").agg(F.count("*").alias("chats"))))  # one row each


def relation(root_a: Column, root_b: Column) -> Column:
    return F.when(root_a == root_b, "forked").otherwise("duplicate")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
