"""Named queries of indexes: vectors in cells, dictionaries of terms, nearest rows of a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.operators import inverted, memory, search, terms
from loquent.plans.queries import _LINES, _POOL, SQL, _LEX, _asked, _index, _with_hubs, query, r6
from loquent.sources.scratch import stored_at
from loquent.sources.tables import messages, table
from loquent.sources.tables import vectors as vecs


def _cells(s: SparkSession, d: str) -> inverted.Cells:
    """The index of all vectors, built and stored once."""
    return inverted.opened(s, stored_at("cells", vecs(s, d), inverted.build))


@query(SQL["knn_csls"])
def knn_indexed(s: SparkSession, d: str) -> DataFrame:
    """``knn_csls`` with its pool from the index, which proves that it is exact."""
    return search.knn_each(_with_hubs(s, d), _asked(s, d), 10, _cells(s, d)).select("query_id", "rank", "id", *r6("distance", "rank_distance"))


# --- full-text search for a table of queries: the first three words of each benchmark item

_LETTERS = "translate({}, 'àâäáãåçèéêëìíîïñòóôöõùúûüýÿœæßÀÂÄÁÉÈÊÇÑÖÜÓÚÍ', '!\"#$%&()*+-./:;<=>?@[]^_`{{|}}~0123456789ABCDEFGHI')"
_NEAR = f"levenshtein({_LETTERS.format('term')}, {_LETTERS.format('asked')})"  # DuckDB counts bytes
_EACH = (
    _LEX[: _LEX.index("m AS (SELECT")]
    + rf"""qw AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')[1:3] AS ws FROM benchmark),
qa AS (SELECT query_id, asked, min(p) AS p FROM (SELECT query_id, unnest(ws) AS asked, generate_subscripts(ws, 1) AS p FROM qw) WHERE length(asked) > 1 GROUP BY ALL),
qt AS (SELECT query_id, asked, p = max(p) OVER (PARTITION BY query_id) AS last, count(*) OVER (PARTITION BY query_id) AS terms, CASE WHEN length(asked) > 3 THEN least(6, round(length(asked) * 0.2)) ELSE 0 END AS e FROM qa),
tm AS (SELECT term, count(DISTINCT id) AS docs FROM i GROUP BY 1),
em AS (SELECT query_id, asked, terms, term, docs, CASE WHEN term = asked THEN 1.0 WHEN last AND starts_with(term, asked) THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(asked))) ELSE 0.45 * length(term) / (length(term) + {_NEAR}) END AS w
  FROM qt JOIN tm ON term = asked OR (last AND starts_with(term, asked)) OR (e > 0 AND abs(length(term) - length(asked)) <= e AND {_NEAR} <= e)),
dfs AS (SELECT field, term, count(DISTINCT id) AS df FROM i GROUP BY 1, 2),
mt AS (SELECT query_id, id, field, term, asked, terms, w * (CASE WHEN field = 'source' THEN 4.0 ELSE 1.0 END) * ln(1 + (docs_in - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (1 - 0.7 + 0.7 * length / mean))) AS s
  FROM em JOIN i USING (term) JOIN (SELECT field, docs AS docs_in, mean FROM z) USING (field) JOIN dfs USING (field, term)),
hits AS (SELECT query_id, id, sum(s) AS score FROM mt GROUP BY 1, 2 HAVING count(DISTINCT asked) = max(terms)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM hits) WHERE rank <= 10)"""
)


def _phrases(s: SparkSession, d: str, most: int = 3) -> DataFrame:
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, most)
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("q"))


def _matches(s: SparkSession, d: str) -> DataFrame:
    postings, sizes, book = _index(s, d)
    return terms.matches_each(book, postings, sizes, _phrases(s, d), {"source": 4.0})


@query(_EACH + " SELECT query_id, id, rank, round(score, 6) AS score FROM best")
def field_search_each(s: SparkSession, d: str) -> DataFrame:
    return terms.search_each(_matches(s, d), limit=10).select("query_id", "id", "rank", *r6("score"))


@query(
    _EACH
    + r""", fm AS (SELECT query_id, id, field, list(DISTINCT term) AS ts FROM mt JOIN best USING (query_id, id) GROUP BY ALL),
ft AS (SELECT fm.*, trim(regexp_replace(coalesce(CASE WHEN field = 'text' THEN text ELSE source END, ''), '\s+', ' ', 'g')) AS flat FROM fm JOIN documents ON doc_id = id),
fp AS (SELECT *, list_min(list_transform(ts, lambda x: nullif(instr(lower(flat), x), 0))) AS pos FROM ft), fe AS (SELECT *, greatest(pos - 70, 1) AS b, least(pos + 70, length(flat)) AS z FROM fp)
SELECT query_id, id, field, sha256(CASE WHEN pos IS NULL THEN flat[1:140] ELSE (CASE WHEN b > 1 THEN '…' ELSE '' END) || flat[b:z] || (CASE WHEN z < length(flat) THEN '…' ELSE '' END) END) AS snippet_hash FROM fe"""
)
def field_matches(s: SparkSession, d: str) -> DataFrame:
    """A snippet for each field of each hit."""
    matches = _matches(s, d)
    found = terms.field_snippets(terms.search_each(matches, limit=10), matches, table(s, d, "documents"), ["text", "source"], "doc_id")
    return found.select("query_id", "id", "field", F.sha2("snippet", 256).alias("snippet_hash"))


_SUGGEST = _EACH[: _EACH.index("dfs AS (SELECT field, term")].rstrip().rstrip(",")


@query(_SUGGEST.replace("AS e FROM qa)", "AS e FROM qa QUALIFY p = max(p) OVER (PARTITION BY query_id))") + ", r AS (SELECT query_id, term AS suggestion, docs AS n, row_number() OVER (PARTITION BY query_id ORDER BY round(docs * w, 9) DESC, term)::INT AS rank FROM em) SELECT * FROM r WHERE rank <= 8")
def field_suggest_each(s: SparkSession, d: str) -> DataFrame:
    return terms.suggest_each(_index(s, d)[2], _phrases(s, d))


# --- searches inside an owner or a chat

_OWN = _POOL.replace("FROM v JOIN hub USING (id), q WHERE v.id <> query_id", "FROM v JOIN hub USING (id), q WHERE v.id <> query_id AND v.id % 4 = query_id % 4")
_PLACES = " SELECT query_id, rank, id, round(rank_distance, 6) AS rank_distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_distance, distance, id)::INT AS rank FROM c) WHERE rank <= 10"


def _owned(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("owner_id", F.col(key) % 4)


@query(_OWN.format(pool=80, pool_by="") + _PLACES)
def owner_search(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector among those of its own owner."""
    found = search.search_each("segments", {"segments": _owned(_with_hubs(s, d), "id")}, _owned(_asked(s, d), "query_id"), scope="owner_id")
    return found.select("query_id", "rank", "id", *r6("rank_distance"))


_RECALL = (
    _LINES.format(size=1)
    + """, t0 AS (SELECT chat_id, 0 AS tier, block_idx, seq_start, seq_end, text FROM b), t1 AS (SELECT chat_id, 1, block_idx // 2 AS block_idx, min(seq_start), max(seq_end), string_agg(text, chr(10) || chr(10) ORDER BY block_idx) FROM t0 GROUP BY 1, 3 HAVING count(*) = 2),
tiers AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1), pool AS (SELECT x.* FROM tiers x WHERE NOT EXISTS (SELECT 1 FROM tiers y WHERE y.chat_id = x.chat_id AND y.tier > x.tier AND y.seq_start <= x.seq_start AND y.seq_end >= x.seq_end)),
nv AS (SELECT count(*) AS nv FROM embeddings), asked AS (SELECT conv_id AS chat_id, string_agg(text, chr(10) ORDER BY turn) AS q FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'system' AND trim(text) <> '') WHERE r <= 2 GROUP BY 1),
near AS (SELECT pool.*, list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS near, 0.1 * seq_start / greatest(max(seq_start) OVER (PARTITION BY chat_id), 1) AS recency,
  len(list_intersect(list_filter(regexp_extract_all(lower(array_to_string(regexp_extract_all(pool.text, '[A-Za-z]+')[2:4], ' ')), '[a-z]+'), lambda x: length(x) >= 4), regexp_extract_all(lower(q), '[\\p{L}\\p{N}]+'))) > 0 AS hit
  FROM pool JOIN asked USING (chat_id), nv JOIN embeddings v ON v.vec_id = (chat_id * 7 + block_idx * 3 + tier) % nv JOIN embeddings w ON w.vec_id = chat_id % nv),
scored AS (SELECT *, CASE WHEN near >= 0.1 THEN near + recency WHEN hit THEN 0.1 + recency END AS score FROM near),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY round(score, 9) DESC, tier, block_idx) AS r FROM scored WHERE score IS NOT NULL) WHERE r <= 3)
SELECT chat_id, tier, block_idx, round(score, 6) AS score, row_number() OVER (PARTITION BY chat_id ORDER BY seq_start, tier)::INT AS place FROM top"""
)


@query(_RECALL)
def chat_recall(s: SparkSession, d: str) -> DataFrame:
    """What each chat recalls of its digests for its last two messages; vectors stand in for those of texts."""
    vectors = vecs(s, d).select("id", "vec")
    n = vectors.count()
    digests = memory.digests(messages(s, d), memory.MemoryConfig(block_size=1, verbatim=0, fan_out=2, max_tier=1))
    known = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 2, 3)
    digests = digests.withColumns({"id": (F.col("chat_id") * 7 + F.col("block_idx") * 3 + F.col("tier")) % n, "keywords": known}).join(vectors, "id").drop("id")
    asked = memory.recent_query(messages(s, d)).select("chat_id", F.col("query").alias("query_text"), (F.col("chat_id") % n).alias("id")).join(vectors, "id")
    cfg = memory.MemoryConfig(mode="mixB", min_score=0.1, recency_bias=0.1, retrieve_k=3)
    return memory.recall_each(digests, asked, cfg).select("chat_id", "tier", "block_idx", *r6("score"), "place")
