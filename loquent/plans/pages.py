"""Named queries of composed pages, images, duplicates, states and files; see ``queries`` for how tables are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.functions import text as tx
from loquent.operators import catalog, dedupe, images, keywords, memory, search, stats, vectors, views
from loquent.plans.queries import _BLOCKS, _FORKS, _POOL, _TAG_SQL, _V, _asked, _tags, _with_hubs, page_home, query
from loquent.sources import archives, cards, chats, scratch
from loquent.sources.tables import activity, messages, table
from loquent.sources.tables import vectors as vecs

# --- duplicates

_CHAT_DUPS = (
    _FORKS.replace("SELECT DISTINCT conv_id AS chat_id, CASE WHEN conv_id // 2 <> conv_id THEN conv_id // 2 END AS parent_id FROM conversations", "SELECT DISTINCT doc_id // 10 AS chat_id, CASE WHEN doc_id // 10 > 0 THEN doc_id // 20 END AS parent_id FROM documents")
    + """, sg AS (SELECT DISTINCT doc_id // 10 AS chat_id, doc_id // 10 % 2 AS owner_id, lang AS model, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id // 10 IN (SELECT doc_id // 10 FROM documents GROUP BY 1 HAVING sum(n_chars) // 200 > 20)),
sn AS (SELECT chat_id, owner_id, model, count(*) AS n FROM sg GROUP BY ALL),
sp AS (SELECT x.chat_id AS a, y.chat_id AS b, x.owner_id, x.model, count(*) AS shared FROM sg x JOIN sg y ON x.h = y.h AND x.owner_id = y.owner_id AND x.model = y.model AND x.chat_id < y.chat_id GROUP BY ALL),
dup AS (SELECT a, b, sp.owner_id, sp.model, shared, shared / (x.n + y.n - shared) AS jaccard, CASE WHEN u.root = w.root THEN 'forked' ELSE 'duplicate' END AS relation
  FROM sp JOIN sn x ON x.chat_id = a AND x.owner_id = sp.owner_id AND x.model = sp.model JOIN sn y ON y.chat_id = b AND y.owner_id = sp.owner_id AND y.model = sp.model JOIN roots u ON u.chat_id = a JOIN roots w ON w.chat_id = b
  WHERE shared / (x.n + y.n - shared) >= 0.1)"""
)


def _chat_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Ten documents in a row are a chat, 200 characters a message."""
    docs = table(s, d, "documents").withColumn("chat_id", F.floor(F.col("doc_id") / 10))
    segs = docs.filter("lang is not null").select("chat_id", (F.col("chat_id") % 2).alias("owner_id"), F.col("lang").alias("model"), F.sha2("text", 256).alias("content_hash"))
    lineage = docs.select("chat_id", F.when(F.col("chat_id") > 0, F.floor(F.col("chat_id") / 2)).alias("parent_id")).distinct()
    sizes = docs.groupBy("chat_id").agg(F.floor(F.sum("n_chars") / 200).alias("messages"))
    return dedupe.chat_duplicates(segs, lineage, sizes, 0.1)


@query(_CHAT_DUPS + " SELECT a, b, owner_id, model, shared, round(jaccard, 6) AS jaccard, relation FROM dup")
def chat_duplicates(s: SparkSession, d: str) -> DataFrame:
    return _chat_duplicates(s, d).withColumn("jaccard", F.round("jaccard", 6))


_PAIR_COUNT = "(SELECT count(*) FROM (SELECT x.vec_id FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35))"


@query(_CHAT_DUPS + f" SELECT {_PAIR_COUNT} AS characters, (SELECT count(*) FROM dup WHERE relation <> 'forked') AS chats")
def duplicate_counts(s: SparkSession, d: str) -> DataFrame:
    ends = vectors.degrees(vecs(s, d).withColumn("grp", F.lit(0)), 0.35)
    return dedupe.duplicate_counts(ends, _chat_duplicates(s, d), F.coalesce((F.sum("degree") / 2).cast("long"), F.lit(0).cast("long")))


# --- themes, pages

_DIGESTS = "g AS (SELECT vec_id AS id, label::BIGINT AS cluster, user_id AS character_id, ts, vec_id % 50 AS chat_id FROM embeddings JOIN events ON event_id = vec_id)"


def _digests(s: SparkSession, d: str) -> DataFrame:
    """Vectors as digests with the theme that is stored with them; time and character are those of the event of that number."""
    log = activity(s, d).select("event_id", "created_at", "character_id")
    return vecs(s, d).join(log, F.col("id") == F.col("event_id")).select("id", F.col("grp").cast("bigint").alias("cluster"), "character_id", "created_at", (F.col("id") % 50).alias("chat_id"))


@query(f"WITH {_DIGESTS}" + " SELECT 'scene' AS level, cluster, count(*) AS members, count(DISTINCT character_id) AS characters, count(DISTINCT chat_id) AS chats FROM g GROUP BY 2 UNION ALL SELECT 'arc', cluster % 3, count(*), count(DISTINCT character_id), count(DISTINCT chat_id) FROM g GROUP BY 2")
def theme_levels(s: SparkSession, d: str) -> DataFrame:
    return views.themes_of(_digests(s, d), {"scene": F.col("cluster"), "arc": F.col("cluster") % 3})


@query(f"WITH {_DIGESTS}" + """, c AS (SELECT cluster, character_id, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, character_id) AS r FROM c)
SELECT cluster, 'members' AS section, '' AS key, count(*)::VARCHAR AS value FROM g GROUP BY 1 UNION ALL SELECT cluster, 'timeline', ((epoch_ms(ts) // 2592000000) * 2592000000)::VARCHAR, count(*)::VARCHAR FROM g GROUP BY 1, 3
UNION ALL SELECT cluster, 'character', character_id::VARCHAR, n::VARCHAR FROM r WHERE r <= 15""")
def theme_pages(s: SparkSession, d: str) -> DataFrame:
    return views.theme_page(_digests(s, d))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    parts = table(s, d, "part").select(F.col("p_partkey").alias("digest_id"), (F.col("p_partkey") % 150).alias("character_id"), words.alias("keywords"))
    return keywords.profiles(keywords.without_hubs(keywords.keyword_rows(parts)))


_DOSSIER = f"WITH {_DIGESTS}" + """, kr AS (SELECT DISTINCT p_partkey AS id, p_partkey % 150 AS c, k FROM (SELECT p_partkey, lower(unnest(string_split(p_name || ' ' || p_type, ' '))) AS k FROM part) WHERE length(k) >= 4),
kt AS (SELECT count(DISTINCT id) AS t FROM kr), kf AS (SELECT k, count(*) AS n FROM kr GROUP BY 1), kg AS (SELECT c AS character_id, k, count(*) AS n FROM kr JOIN kf USING (k), kt WHERE NOT kf.n > 0.5 * t GROUP BY 1, 2),
kk AS (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY n DESC, k) AS r FROM kg)
SELECT user_id AS character_id, 'messages' AS section, '' AS key, count(*)::VARCHAR AS value FROM events GROUP BY 1
UNION ALL SELECT user_id, 'first_day', '', strftime(min(ts), '%Y-%m-%d') FROM events GROUP BY 1 UNION ALL SELECT user_id, 'last_day', '', strftime(max(ts), '%Y-%m-%d') FROM events GROUP BY 1
UNION ALL SELECT user_id, 'model', event_type, count(*)::VARCHAR FROM events WHERE event_type IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT character_id, 'theme', cluster::VARCHAR, count(*)::VARCHAR FROM g GROUP BY 1, 3 UNION ALL SELECT character_id, 'keyword', k, n::VARCHAR FROM kk WHERE r <= 25"""


@query(_DOSSIER)
def character_dossiers(s: SparkSession, d: str) -> DataFrame:
    return views.dossiers(activity(s, d), _digests(s, d), _profiles(s, d))


@query(
    _CHAT_DUPS
    + f""", {_DIGESTS}, top AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10), th AS (SELECT cluster, count(*) AS n FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
SELECT 'totals' AS section, 'messages' AS key, count(*)::DOUBLE AS value FROM conversations UNION ALL SELECT 'totals', 'events', count(*) FROM events
UNION ALL SELECT 'model', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'hour', hour(ts)::VARCHAR, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'character', user_id::VARCHAR, n FROM top UNION ALL SELECT 'theme', cluster::VARCHAR, n FROM th
UNION ALL SELECT 'duplicates', 'characters', {_PAIR_COUNT} UNION ALL SELECT 'duplicates', 'chats', (SELECT count(*) FROM dup WHERE relation <> 'forked')"""
)
def home_view(s: SparkSession, d: str) -> DataFrame:
    top = stats.counts_by(activity(s, d), "character_id", "n").orderBy(F.desc("n"), "character_id").limit(10)
    most = stats.counts_by(_digests(s, d), "cluster", "n").orderBy(F.desc("n"), "cluster").limit(8)
    dups = duplicate_counts(s, d).select(F.explode(F.create_map(F.lit("characters"), "characters", F.lit("chats"), "chats")).alias("key", "n"))
    out = page_home(s, d)
    for name, rows in (("character", top), ("theme", most), ("duplicates", dups)):
        out = out.union(rows.toDF("key", "n").select(F.lit(name), F.col("key").cast("string"), F.col("n").cast("double")))
    return out


@query("SELECT DISTINCT user_id AS character_id, event_type AS model FROM events WHERE event_type IS NOT NULL")
def distinct_models(s: SparkSession, d: str) -> DataFrame:
    return views.distinct_models(activity(s, d))


@query(_TAG_SQL + ", known AS (SELECT DISTINCT lower(p_brand) AS tag FROM part WHERE p_partkey % 2 = 0 AND p_size < 10), f AS (SELECT * FROM t WHERE length(tag) >= 2 AND tag NOT IN (SELECT tag FROM known)), n AS (SELECT tag, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 2) SELECT tag, id, n FROM f JOIN n USING (tag)")
def suggestion_members(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "part").filter("p_partkey % 2 = 0 and p_size < 10").select(F.col("p_brand").alias("tag"))
    return views.suggestion_members(catalog.tag_rows(_tags(s, d), "id", "tags"), known)


# --- images


def _versions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("character_id"), (F.col("c_custkey") % 300).alias("asset_id"))


@query(_V + """p AS (SELECT q.id AS query_id, v.id, 1 - list_cosine_similarity(v.e, q.e) AS distance FROM v, v q WHERE q.id % 50 = 0 AND q.id <> v.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM p)
SELECT query_id, rank, id, round(distance, 6) AS distance, c_custkey AS character_id FROM r LEFT JOIN customer ON c_custkey % 300 = id WHERE rank <= 10""")
def image_search(s: SparkSession, d: str) -> DataFrame:
    asked = vecs(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return images.image_search(vecs(s, d), _versions(s, d), asked).withColumn("distance", F.round("distance", 6))


@query(_V + """a AS (SELECT c_custkey AS c, id, e FROM customer JOIN v ON id = c_custkey % 300), q AS (SELECT * FROM a WHERE c % 50 = 0), dist AS (SELECT x.id AS own, y.id, CASE WHEN x.id = y.id THEN 0.0 ELSE 1 - list_cosine_similarity(x.e, y.e) END AS distance FROM (SELECT DISTINCT id, e FROM q) x, (SELECT DISTINCT id, e FROM a) y),
r AS (SELECT q.c AS query_id, a.c AS character_id, distance, row_number() OVER (PARTITION BY q.c ORDER BY distance, a.c)::INT AS rank FROM q JOIN dist ON dist.own = q.id JOIN a ON a.id = dist.id WHERE a.c <> q.c)
SELECT query_id, rank, character_id, round(1 - distance, 6) AS similarity FROM r WHERE rank <= 10""")
def similar_art(s: SparkSession, d: str) -> DataFrame:
    held = images.avatars(vecs(s, d), _versions(s, d))
    return images.similar_art(held, held.filter("character_id % 50 = 0").select("character_id")).withColumn("similarity", F.round("similarity", 6))


@query()
def visual_archetypes(s: SparkSession, d: str) -> DataFrame:
    facets = table(s, d, "customer").select(F.col("c_custkey").alias("character_id"), F.col("c_mktsegment").alias("genre"), F.col("c_nationkey").cast("string").alias("tone"))
    return images.visual_archetypes(images.avatars(vecs(s, d), _versions(s, d)), facets)


# --- search over several tables


_FOUND = _POOL.format(pool=40, pool_by=", half")


@query(_FOUND + """, o AS (SELECT query_id, CASE WHEN half = 0 THEN 'character' ELSE 'segment' END AS kind, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY rank_distance, distance, half, id)::INT AS rank FROM c)
SELECT query_id, rank, kind, id, round(distance, 6) AS distance, c_name AS name FROM o JOIN customer ON c_custkey = id + 1 WHERE rank <= 10""")
def find_search(s: SparkSession, d: str) -> DataFrame:
    rows = _with_hubs(s, d)
    tables = {"characters": rows.filter("id % 2 = 0"), "segments": rows.filter("id % 2 = 1")}
    names = table(s, d, "customer").select((F.col("c_custkey") - 1).alias("id"), F.col("c_name").alias("name"))
    found = search.named(search.search_each("characters", tables, _asked(s, d)), names)
    return found.select("query_id", "rank", "kind", "id", F.round("distance", 6).alias("distance"), "name")


_ARCS = _POOL.replace("FROM v JOIN hub USING (id), q WHERE v.id <> query_id", "FROM v JOIN hub USING (id), q WHERE v.id <> query_id AND v.id % 3 > 0")


@query(_ARCS.format(pool=40, pool_by="") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_distance, distance, id)::INT AS rank FROM c) SELECT query_id, rank, id, round(rank_distance, 6) AS rank_distance FROM r WHERE rank <= 10")
def arc_search(s: SparkSession, d: str) -> DataFrame:
    digests = _with_hubs(s, d).withColumn("tier", F.col("id") % 3)
    return search.search_each("arcs", {"digests": digests}, _asked(s, d)).select("query_id", "rank", "id", F.round("rank_distance", 6).alias("rank_distance"))


@query(_POOL.format(pool=160, pool_by="") + r""", placed AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank_distance, distance, id) AS place FROM c),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS ws FROM documents), y AS (SELECT query_id, id, place, list_distinct(a.ws[1:5]) AS asked, b.ws FROM placed JOIN w a ON a.doc_id = query_id JOIN w b ON b.doc_id = id WHERE place <= 40),
z AS (SELECT query_id, id, place, len(list_intersect(ws, asked)) / greatest(1, len(asked)) AS score FROM y)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place)::INT AS rank FROM z) WHERE rank <= 10""")
def search_reranked(s: SparkSession, d: str) -> DataFrame:
    """The forty nearest of each query, ranked anew by the words that they share with its first five."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0)), 1, 5), " ")
    asked = docs.select(F.col("id").alias("query_id"), first.alias("query_text"))
    hits = search.knn_each(_with_hubs(s, d), _asked(s, d), 40).select("query_id", "id", "rank").join(docs, "id").join(asked, "query_id")
    return search.rerank_each(hits).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# --- states and backfills


@query(
    _BLOCKS.format(size=3).replace(" SELECT chat_id, block_idx, seq_start, seq_end, n, seqs[n // 2 + 1] AS seq_mid, sha256(text) AS content_hash FROM b", "")
    + " SELECT chat_id, block_idx, list(conv_id * 1000 + turn ORDER BY turn)[count(*) // 2 + 1] AS mid_at FROM b JOIN conversations ON conv_id = chat_id AND turn BETWEEN seq_start AND seq_end WHERE block_idx % 2 = 0 GROUP BY 1, 2"
)
def mid_time_backfill(s: SparkSession, d: str) -> DataFrame:
    made = memory.blocks(messages(s, d), 3).select("chat_id", F.lit(0).alias("tier"), "block_idx", "seq_start", "seq_end", F.when(F.col("block_idx") % 2 == 1, 0).cast("bigint").alias("mid_at"))
    timed = messages(s, d).select("chat_id", "seq", (F.col("chat_id") * 1000 + F.col("seq")).alias("created_at"))
    return views.mid_times(made, timed).select("chat_id", "block_idx", "mid_at")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL")
def hash_backfill(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("content_hash"))
    return views.missing_hashes(rows.filter("doc_id % 2 = 1 or content_hash is not null"), "text").select("doc_id", "content_hash")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS total FROM events")
def running_totals(s: SparkSession, d: str) -> DataFrame:
    return views.running_totals(activity(s, d), "character_id", ["created_at", "event_id"], "value").select("event_id", F.round("total", 3).alias("total"))


@query("SELECT n_name AS nation, count(*) AS lines, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def composite_join(s: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(s, d, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("lines"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def asset_collection(s: SparkSession, d: str) -> DataFrame:
    uses = [table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), table(s, d, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("p_partkey"))]
    return views.unreferenced(table(s, d, "part").select("p_partkey", "p_name"), uses, "p_partkey")


@query("SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def lore_union(s: SparkSession, d: str) -> DataFrame:
    part = lambda name, k: table(s, d, name).select(F.lit(name).alias("kind"), F.col(f"{k}key").cast("bigint").alias("id"), F.col(f"{k[:2]}name").alias("name"))
    return part("supplier", "s_supp").union(part("customer", "c_cust")).union(part("nation", "n_nation"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 AS active, l_partkey AS content FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 3 + 1")
def selected_variants(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("active"))
    variants = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("idx"), F.col("l_partkey").alias("content"))
    return views.selected(asked, variants)


@query("SELECT o_orderpriority AS priority, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1")
def prepared_statement(s: SparkSession, d: str) -> DataFrame:
    """SQL text with parameters, over a table that is handed in."""
    sql = "SELECT o_orderpriority AS priority, count(*) AS n, max(o_orderkey) AS last FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least GROUP BY 1"
    return s.sql(sql, args={"status": "F", "least": 1000}, orders=table(s, d, "orders"))


@query("SELECT conv_id AS chat_id, count(*) AS messages, sum(ceil(length(text) / 3.67))::BIGINT AS tokens, arg_max(role, turn) AS last_role, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END)::BIGINT AS hidden FROM conversations GROUP BY 1")
def chat_inspector(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).groupBy("chat_id").agg(F.count("*").alias("messages"), F.sum(tx.approx_tokens(F.col("content"))).alias("tokens"), F.max_by("role", "seq").alias("last_role"), F.count_if(F.col("role") == "system").alias("hidden"))


# --- files

_CHAT_ROWS = "SELECT conv_id AS chat_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT - 1 AS seq, role, sha256(coalesce(text, '')) AS content_hash FROM conversations"


def _read_back(lines: DataFrame) -> DataFrame:
    rows = chats.messages(lines)
    return rows.select(F.regexp_extract("file", r"chat_id=(\d+)", 1).cast("bigint").alias("chat_id"), F.col("seq").cast("int").alias("seq"), "role", F.sha2("content", 256).alias("content_hash"))


@query(_CHAT_ROWS)
def chat_files(s: SparkSession, d: str) -> DataFrame:
    """Every chat written to a file of JSON lines and read back from it."""
    path = f"{scratch.folder(s)}/loquent-chats-{uuid.uuid4().hex}"
    chats.write_files(chats.write_lines(messages(s, d)), path)
    return _read_back(chats.read_lines(s, path, "*.txt"))


@query(_CHAT_ROWS)
def chat_archives(s: SparkSession, d: str) -> DataFrame:
    """Every chat packed into an archive and read back from it."""
    lines = chats.write_lines(messages(s, d))
    whole = lines.groupBy("chat_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("value"))  # a chat is a file
    name = F.concat(F.lit("chat_id="), F.col("chat_id").cast("string"), F.lit("/main.jsonl"))
    held = whole.select(name.alias("archive"), archives.zipped(name, F.col("value")).alias("content"))
    return _read_back(chats.lines_of(archives.entries(held).filter("state = 'ok'").select("file", F.decode("content", "UTF-8").alias("value"))))


@query("SELECT p_partkey AS id, p_name AS name, p_type AS description, p_brand AS first_tag, 2 AS n_tags, 'p' || p_partkey::VARCHAR AS handle FROM part")
def card_images(s: SparkSession, d: str) -> DataFrame:
    """Parts as cards, written as JSON into images and read back from these."""
    rows = table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand", F.lit("part")).alias("tags"))
    file = F.concat(F.lit("cards/P"), F.col("p_partkey").cast("string"), F.lit(".png"))
    image = rows.withColumn("image", cards.card_image(cards.card_v3(rows.drop("p_partkey")))).select(file.alias("file"), "image")
    found = cards.parsed(image.select("file", cards.png_card("image").alias("json")))
    return found.select(F.regexp_extract("file", r"P(\d+)", 1).cast("bigint").alias("id"), "name", "description", F.get("tags", F.lit(0)).alias("first_tag"), F.size("tags").alias("n_tags"), "handle")


