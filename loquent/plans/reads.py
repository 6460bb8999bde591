"""Named queries of smaller reads: keyword pairs of owners, swipes by model and with texts, stored duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.operators import dedupe, keywords, stats
from loquent.plans.pages import _CHAT_DUPS, _chat_duplicates
from loquent.plans.queries import _PART_WORDS, query
from loquent.sources.tables import table


@query(
    _PART_WORDS.replace("SELECT DISTINCT p_partkey AS id,", "SELECT DISTINCT p_partkey AS id, p_partkey % 3 AS owner_id,")
    + ", p AS (SELECT x.owner_id, x.k AS a, y.k AS b, count(*) AS n FROM g x JOIN g y ON x.id = y.id AND x.k < y.k GROUP BY ALL) SELECT owner_id, a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, a, b) AS r FROM p) WHERE r <= 200"
)
def owner_cooccurrence(s: SparkSession, d: str) -> DataFrame:
    """The most frequent pairs of keywords of each of three owners."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    parts = table(s, d, "part").select(F.col("p_partkey").alias("digest_id"), (F.col("p_partkey") % 3).alias("owner_id"), F.col("p_brand").alias("character_id"), words.alias("keywords"))
    rows = keywords.without_hubs(keywords.keyword_rows(parts))
    return keywords.cooccurrence(rows, most=200, scope="owner_id").select("owner_id", "a", "b", "n")


@query("SELECT l_returnflag AS model, count(*) AS variants, count(DISTINCT l_orderkey) AS messages, round(count(*) / count(DISTINCT l_orderkey), 6) AS average FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 5 ORDER BY count(*) / count(DISTINCT l_orderkey) DESC, 1 LIMIT 20")
def swipes_by_model(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_returnflag").alias("model"))
    return stats.swipes_by(rows, "model").withColumn("average", F.round("average", 6))


@query("SELECT h.*, sha256(text[1:280]) AS snippet_hash FROM (SELECT l_orderkey AS message_id, count(*) AS variants FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) h LEFT JOIN documents ON doc_id = message_id")
def swipe_hotspot_texts(s: SparkSession, d: str) -> DataFrame:
    hotspots = stats.swipe_hotspots(table(s, d, "lineitem").select(F.col("l_orderkey").alias("message_id")))
    texts = table(s, d, "documents").select(F.col("doc_id").alias("message_id"), F.col("text").alias("content"))
    return stats.hotspot_texts(hotspots, texts).select("message_id", "variants", F.sha2("snippet", 256).alias("snippet_hash"))


@query(_CHAT_DUPS + " SELECT a, b, owner_id, model, round(jaccard, 6) AS jaccard FROM dup WHERE relation <> 'forked' AND owner_id = 1 ORDER BY round(dup.jaccard, 9) DESC, a, b LIMIT 100")
def duplicate_reads(s: SparkSession, d: str) -> DataFrame:
    """One owner's duplicate chats that are no forks, the likest first."""
    found = dedupe.read_duplicates(_chat_duplicates(s, d), 0.1, owner=1)
    return found.select("a", "b", "owner_id", "model", F.round("jaccard", 6).alias("jaccard"))
