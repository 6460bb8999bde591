"""Named queries of upkeep: blocks and digests kept up to date, spans that hold others, stores and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.operators import clusters, tiers
from loquent.operators.memory import MemoryConfig
from loquent.plans.queries import _BLOCKS, query
from loquent.sources import assets, cards, scratch, transfer
from loquent.sources.tables import messages, table
from loquent.sources.tables import vectors as vecs
from loquent.streaming import blocks


@query(_BLOCKS.format(size=3))
def streamed_blocks(s: SparkSession, d: str) -> DataFrame:
    """The blocks of all chats as a stream of their messages makes them."""
    place = f"{scratch.folder(s)}/loquent-stream-{uuid.uuid4().hex}"
    kinds = s.read.parquet(f"{d}/conversations.parquet").schema
    rows = s.readStream.schema(kinds).parquet(f"{d}/conversation[s].parquet")  # a pattern may be a file or a folder
    messages = rows.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.lit(0).alias("version"))
    blocks.keep(messages, f"{place}/blocks", f"{place}/checkpoint", 3).awaitTermination()
    found = blocks.current(s.read.schema(blocks.SCHEMA).parquet(f"{place}/blocks"))
    return found.select("chat_id", "block_idx", "seq_start", "seq_end", "n", "seq_mid", "content_hash")


# --- digests of all tiers after messages came, went and were edited


def _grid(name: str, where: str) -> str:
    """The digests of the messages that ``where`` leaves: blocks of two behind the last message, and two tiers of two each."""
    up = lambda k: f"{name}{k + 1} AS (SELECT chat_id, block_idx // 2 AS block_idx, min(s) AS s, max(e) AS e, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS text FROM {name}{k} GROUP BY 1, 2 HAVING count(*) = 2)"
    return (
        rf"""{name}h AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last, (CASE WHEN role = 'user' THEN 'User' ELSE 'Character' END) || ': ' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM conversations WHERE role <> 'system' AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND {where}),
{name}g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM {name}h WHERE turn <= last - 1),
{name}b AS (SELECT conv_id AS chat_id, (nth // 2)::INT AS block_idx, min(turn) AS s, max(turn) AS e, count(*) AS n, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS text FROM {name}g GROUP BY 1, 2),
{name}0 AS (SELECT * EXCLUDE (n) FROM {name}b WHERE chat_id IN (SELECT chat_id FROM {name}b WHERE block_idx = 0 AND n = 2)), """
        + ", ".join(map(up, (0, 1)))
    )


_WERE, _ARE = "NOT (conv_id % 4 = 1 AND turn > 3)", "NOT (conv_id % 4 = 0 AND turn > 3)"
_MARK = "SELECT x.*, y.chat_id IS NULL OR y.s <> x.s OR y.e <> x.e OR {why} AS due FROM new{k} x LEFT JOIN old{k} y USING (chat_id, block_idx)"
_RISEN = _MARK + " LEFT JOIN (SELECT chat_id, block_idx // 2 AS block_idx, bool_or(due) AS child FROM due{below} GROUP BY 1, 2) z USING (chat_id, block_idx)"
_PART = "SELECT chat_id, {k} AS tier, block_idx, '{state}' AS state, s AS seq_start, e AS seq_end, sha256(text) AS text_hash FROM "


@query(
    f"WITH {_grid('old', _WERE)}, {_grid('new', _ARE)}, due0 AS ({_MARK.format(k=0, why='x.chat_id % 5 = 1 AND 1 BETWEEN x.s AND x.e')}), due1 AS ({_RISEN.format(k=1, below=0, why='child')}), due2 AS ({_RISEN.format(k=2, below=1, why='child')}) "
    + " UNION ALL ".join(f"{_PART.format(k=k, state='built')} due{k} WHERE due UNION ALL {_PART.format(k=k, state='gone').replace('s AS seq_start, e AS seq_end, sha256(text)', 'NULL AS seq_start, NULL AS seq_end, NULL')} (SELECT * FROM old{k} ANTI JOIN new{k} USING (chat_id, block_idx))" for k in range(3))
)
def digest_upkeep(s: SparkSession, d: str) -> DataFrame:
    """Of digests that were whole once, those built again and those that went: messages came, went and were edited since."""
    cfg = MemoryConfig(block_size=2, verbatim=1, fan_out=2, max_tier=2)
    stored = tiers.replay(messages(s, d).filter(_WERE.replace("conv_id", "chat_id").replace("turn", "seq")), 100, cfg)
    edits = messages(s, d).filter("chat_id % 5 = 1 and seq = 1").select("chat_id", "seq", F.lit(200).alias("edited_at"))
    now = tiers.keep_up(messages(s, d).filter(_ARE.replace("conv_id", "chat_id").replace("turn", "seq")), stored, edits, 300, cfg)
    built = now.built.select("chat_id", "tier", "block_idx", F.lit("built").alias("state"), "seq_start", "seq_end", F.sha2("text", 256).alias("text_hash"))
    return built.unionByName(now.gone.withColumn("state", F.lit("gone")), allowMissingColumns=True)


# --- themes of every owner and level


@query("""
WITH g AS (SELECT vec_id AS id, vec_id % 3 AS owner_id, CASE WHEN vec_id % 4 = 0 THEN 'arc' ELSE 'scene' END AS level, vec_id % 7 AS character_id FROM embeddings WHERE vec_id % 3 < 2 OR vec_id < 20)
SELECT owner_id, level, CASE WHEN level = 'arc' THEN 4 ELSE 8 END::BIGINT AS themes, count(*) AS members, count(DISTINCT character_id) AS characters FROM g GROUP BY ALL HAVING count(DISTINCT id % 400) > CASE WHEN level = 'arc' THEN 4 ELSE 8 END""")
def owner_themes(s: SparkSession, d: str) -> DataFrame:
    """Digests of three owners, the third with too few for themes; copies by their hash count once where themes are made."""
    rows = vecs(s, d).filter("id % 3 < 2 or id < 20").withColumns({"owner_id": F.col("id") % 3, "level": F.when(F.col("id") % 4 == 0, "arc").otherwise("scene"), "content_hash": F.md5((F.col("id") % 400).cast("string"))})
    found = clusters.themes(rows, F.when(F.col("level") == "arc", 4).otherwise(8), rounds=10).withColumn("character_id", F.col("id") % 7)
    return found.groupBy("owner_id", "level").agg(F.count_distinct("cluster").alias("themes"), F.count("*").alias("members"), F.count_distinct("character_id").alias("characters"))


# --- a content-addressed store


@query("SELECT sha256(text) AS digest, strlen(text) AS size, CASE WHEN bool_or(doc_id % 2 = 0) THEN 1 ELSE 2 END AS put, true AS ok FROM documents WHERE text IS NOT NULL GROUP BY text")
def stored_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts of even documents put into a store, then all; what it lists, with the put that made it, verified."""
    path = f"{scratch.folder(s)}/loquent-assets-{uuid.uuid4().hex}"
    texts = table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    assets.put(texts.filter("doc_id % 2 = 0"), path)
    created = assets.put(texts, path).select("digest", F.when(F.col("created"), 2).otherwise(1).alias("put"))
    return assets.listed(s, path).join(created, "digest").join(assets.verified(s, path), "digest").select("digest", "size", "put", "ok")


# --- characters with lorebooks


@query("""
SELECT p_partkey % 2 AS owner_id, p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus = 'F')::INT - 1 AS pos, l_returnflag AS title, l_orderkey::VARCHAR AS second_key,
  'line ' || l_linenumber::VARCHAR AS content, l_linestatus = 'F' AS enabled, l_linenumber::DOUBLE AS priority, 1 AS version
FROM part JOIN lineitem ON l_partkey = p_partkey""")
def character_lore(s: SparkSession, d: str) -> DataFrame:
    """Parts as characters of two owners with a lorebook entry for each line, exported as cards and imported from these."""
    who = [(F.col("p_partkey") % 2).alias("owner_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("handle"), F.lit(1).alias("version")]
    parts, lines = table(s, d, "part"), table(s, d, "lineitem")
    versions = parts.select(*who, F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("tags"))
    order = F.struct("l_orderkey", "l_linenumber").alias("pos")
    lore = lines.withColumnRenamed("l_partkey", "p_partkey").select(*who, order, F.array("l_returnflag", F.col("l_orderkey").cast("string")).alias("keys"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("content"), (F.col("l_linestatus") == "F").alias("enabled"), F.col("l_linenumber").cast("double").alias("priority"))
    out = transfer.export_cards(versions, lore)
    found = cards.parsed(out.select(F.concat_ws("/", "owner_id", "handle").alias("file"), "json"))
    texts = out.select(F.concat_ws("/", "owner_id", "handle").alias("file"), "owner_id", "json")
    found = found.join(texts.hint("merge"), "file").withColumn("import_hash", F.sha2("json", 256))
    made = transfer.import_cards(found, s.createDataFrame([], "owner_id bigint, handle string, version int, import_hash string"))
    named = made.versions.select("owner_id", "handle", "name")
    rows = made.lore.join(named.hint("merge"), ["owner_id", "handle"])
    return rows.select("owner_id", F.expr("bigint(substring(handle, 2))").alias("id"), "name", "pos", "title", F.get("keys", F.lit(1)).alias("second_key"), "content", "enabled", "priority", "version")
