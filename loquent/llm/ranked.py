"""Ranked lexical search over a tiered index: postings of high impact first, and a bound on what the tiers below add.

The index lies in shards of documents. Of each term of a shard it holds the postings in tiers of falling impact (the
term's weight times the saturated frequency) and the largest impact of each tier. A round of search reads one tier
more: what it has found so far is a lower bound of scores, and with the bounds of the tiers not read an upper one.
An item whose bounds prove in a shard that no document can still come in is done there; all others fall through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquent.llm.common import BROADCAST_ROWS, join_small, materialize, sliced, text_or_empty

#: Bytes of terms: digits, letters (A-Z in lower case) and all of other scripts; the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
#: A shard ends once it holds so many documents, or terms that take so many bytes as numbers.
SHARD_ROWS, SHARD_BYTES = 8192, 1 << 26
#: Classes of impact in the histogram that parts tiers, to an octave.
PER_OCTAVE = 4

LISTS = "shard bigint, term string, at array<int>, tf array<int>, n array<int>, ids array<bigint>"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def lists(docs: DataFrame, asked: list[str] | None = None, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each shard a row for each term: places of its documents, frequencies and their lengths; and one of ids and lengths.

    ``asked``: the terms to index, of a counted number; all if None. A task makes its own shards; texts don't move.
    """
    known = None if asked is None else {t.encode(): i for i, t in enumerate(asked)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        ids: list[int | None] = []
        n: list[int] = []
        codes: list[np.ndarray] = []
        seen: dict[bytes, int] = {} if known is None else known
        size = 0
        for batch in sliced(batches, 256):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(body.as_py())
                size += 8 * len(words)
                found = [seen.setdefault(w, len(seen)) for w in words] if known is None else [c for c in map(seen.get, words) if c is not None]
                ids.append(key)
                n.append(len(words))
                codes.append(np.array(found, np.int64))
                if len(ids) >= shard_rows or size >= SHARD_BYTES:
                    yield from told(shard, ids, n, codes, seen)
                    shard, ids, n, codes, size = shard + 1, [], [], [], 0
                    seen = {} if known is None else known
        if ids:
            yield from told(shard, ids, n, codes, seen)

    def told(shard: int, ids: list, n: list, codes: list, seen: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        both = np.concatenate(codes) * len(ids) + np.repeat(np.arange(len(ids)), [len(c) for c in codes])
        both, tf = np.unique(both, return_counts=True)
        code, at = both // len(ids), both % len(ids)
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        names = list(seen)
        offsets = pa.array(np.append(begin, len(code)), pa.int32())
        listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()))
        rows = len(begin)
        columns = [pa.array([shard] * rows, pa.int64()), pa.array([names[c].decode() for c in code[begin]], pa.string()), listed(at), listed(tf), listed(np.array(n, np.int64)[at]), pa.nulls(rows, pa.list_(pa.int64()))]
        fields = ["shard", "term", "at", "tf", "n", "ids"]
        for k in range(0, rows, 1024):
            yield pa.RecordBatch.from_arrays([c.slice(k, 1024) for c in columns], fields)
        own = [pa.array([shard], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(own, fields)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(build, LISTS)


def _spread(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lists of a batch, end to end: row, place, saturated frequency and impact of each posting."""
    flat = lambda name: batch.column(name).flatten().to_numpy().astype(np.int64)
    tf, n = flat("tf"), flat("n")
    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("at").offsets.to_numpy()))
    m = 100 - 25 + (25 * n * n_docs) // max(1, n_terms)
    part = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
    return row, flat("at"), part, batch.column("w").to_numpy()[row] * part


def tiers(held: DataFrame, shares: Sequence[float] = (0.1, 0.6), n_asked: int = BROADCAST_ROWS + 1) -> DataFrame:
    """The index: shard, tier, term, w, at, part, top; and ids of each shard (tier -1, no term).

    Tier 0 has the postings of largest impact, a share of ``shares[0]`` of all, and so on; where they part is read from a
    histogram. Tier -1 has, of each term, ``top``: the largest impact in each tier.
    """
    own = held.filter("term is null").select("shard", F.explode("n").alias("n"))
    facts = own.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = facts["docs"], facts["terms"]
    postings = held.filter("term is not null")
    df = postings.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    w = df.select("term", F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w"))
    weighed = join_small(postings.select("shard", "term", "at", "tf", "n"), w, "term", n_asked)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64 * PER_OCTAVE, np.int64)
        for batch in sliced(batches, 512):
            total += np.bincount(octave(_spread(batch, n_docs, n_terms)[3]), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["class", "n"])

    def octave(impact: np.ndarray) -> np.ndarray:
        return (PER_OCTAVE * np.log2(impact + 1)).astype(np.int64)

    counted = weighed.mapInArrow(classes, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect()  # 256 rows
    by_class = np.zeros(64 * PER_OCTAVE, np.int64)
    for r in counted:
        by_class[r["class"]] = r["n"]
    above = np.cumsum(by_class[::-1])[::-1]  # postings of this class or a higher one
    cuts = [int(np.flatnonzero(above >= share * above[0])[-1]) for share in shares]
    last = len(shares)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            row, at, sat, impact = _spread(batch, n_docs, n_terms)
            level = octave(impact)
            tier = np.sum([level < c for c in cuts], axis=0)
            top = np.zeros((batch.num_rows, last + 1), np.int64)
            np.maximum.at(top, (row, tier), impact)
            order = np.lexsort((at, tier, row))
            key = (row * (last + 1) + tier)[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            offsets = pa.array(np.append(begin, len(key)), pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int32()))
            one = batch.take(pa.array(key[begin] // (last + 1)))
            yield pa.RecordBatch.from_arrays([one.column("shard"), pa.array(key[begin] % (last + 1), pa.int32()), one.column("term"), one.column("w"), listed(at), listed(sat), pa.nulls(len(begin), pa.list_(pa.int64()))], names)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array([-1] * batch.num_rows, pa.int32()), batch.column("term"), batch.column("w"), none, none, pa.array(list(top), pa.list_(pa.int64()))], names)

    names = ["shard", "tier", "term", "w", "at", "part", "top"]
    made = weighed.mapInArrow(part, "shard bigint, tier int, term string, w bigint, at array<int>, part array<int>, top array<bigint>")
    ids = held.filter("term is null").select("shard", F.lit(-1).alias("tier"), F.col("ids").alias("top"))
    return made.unionByName(ids, allowMissingColumns=True)


def item_terms(items: DataFrame, id_col: str = "item_id", text: str = "text", block: int = 128) -> DataFrame:
    """item, block, terms and how often each is asked for; rows without an id go, of those that repeat one the least text stays."""
    one = items.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item")).agg(F.min(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = [np.unique(np.array(terms_of(t), object), return_counts=True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([[w.decode() for w in x[0]] for x in words], pa.list_(pa.string())), pa.array([x[1].tolist() for x in words], pa.list_(pa.int64()))], ["item", "terms", "times"])

    made = materialize(one.withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(split, "item bigint, terms array<string>, times array<bigint>"))
    n_blocks = max(1, -(-made.count() // block))
    return made.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int"))


def _round(open_pairs: DataFrame, index: DataFrame, upto: int, k: int) -> DataFrame:
    """One round over the tiers up to ``upto``: for each open pair its best documents so far, and a row of what may still come.

    open_pairs: shard, block, item, terms, times. Returned: shard, block, item, doc_id, score, exact; where exact is
    null, score is the most that a document without a known score may reach.
    """
    wanted = open_pairs.select("block", F.explode("terms").alias("term")).distinct()
    places = open_pairs.select("shard", "block").distinct()
    wanted, places = materialize(wanted), materialize(places)
    read = index.filter((F.col("tier") <= upto) & F.col("term").isNotNull())
    n_terms, n_places = wanted.count(), places.count()
    hint = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    read = read.join(hint(wanted, n_terms), "term").join(hint(places, n_places), ["shard", "block"], "left_semi")
    ids = index.filter("term is null").join(hint(places, n_places), "shard")
    rows = read.unionByName(ids, allowMissingColumns=True)
    rows = rows.select(F.col("shard").alias("shard"), F.col("block").alias("block"), "tier", "term", "w", "at", "part", "top")

    def meet(pairs: pa.Table, postings: pa.Table) -> pa.Table:
        made: tuple[list, ...] = ([], [], [], [])
        if pairs.num_rows:
            for item, terms, times in zip(*(pairs.column(c).to_pylist() for c in ("item", "terms", "times"))):
                for out, x in zip(made, (item, terms, times)):
                    out.append(x)
        found: list[tuple[int, int | None, int, bool | None]] = []
        if made[0] and postings.num_rows:
            found = best(*made[:3], postings)
        shard, block = (pairs if pairs.num_rows else postings).select(["shard", "block"]).slice(0, 1).to_pylist()[0].values()
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.table({"shard": pa.array([shard] * len(found), pa.int64()), "block": pa.array([block] * len(found), pa.int32()), "item": pa.array(columns[0], pa.int64()), "doc_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64()), "exact": pa.array(columns[3], pa.bool_())})

    def best(items: list[int], terms: list[list[str]], times: list[list[int]], postings: pa.Table) -> list[tuple]:
        tier, term, w = (postings.column(c).to_pylist() for c in ("tier", "term", "w"))
        at, sat, top = (postings.column(c).combine_chunks() for c in ("at", "part", "top"))
        lists: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rest: dict[str, int] = {}
        ids = np.zeros(0, np.int64)
        known = np.zeros(0, bool)
        for i, name in enumerate(term):
            if name is None:
                ids = top[i].values.to_numpy(zero_copy_only=False)
                known = np.isfinite(ids.astype(float))
                ids = np.where(known, ids, 0).astype(np.int64) if not known.all() else ids.astype(np.int64)
            elif tier[i] < 0:
                rest[name] = max(top[i].as_py()[upto + 1 :], default=0)
            else:
                lists.setdefault(name, []).append((at[i].values.to_numpy(), sat[i].values.to_numpy().astype(np.int64) * w[i]))
        out = []
        for item, words, counts in zip(items, terms, times):
            score, settled = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            more = 0
            for word, n in zip(words, counts):
                left = n * rest.get(word, 0)
                more += left
                for place, impact in lists.get(word, ()):
                    score[place] += n * impact
                    if left:
                        settled[place] += left
            open_ = (settled < more) & known
            out.append((item, None, int((score + more - settled)[open_].max(initial=0)), None))
            hit = np.flatnonzero((score > 0) & known)
            if len(hit) > k:
                least = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                hit = hit[score[hit] >= least]
            order = hit[np.lexsort((ids[hit], -score[hit]))][:k]
            out.extend((item, int(ids[d]), int(score[d]), not open_[d]) for d in order)
        return out

    shape = "shard bigint, block int, item bigint, doc_id bigint, score bigint, exact boolean"
    return open_pairs.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInArrow(meet, shape)


def _first(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 20, n_tiers: int = 3) -> DataFrame:
    """item, rank, doc_id and score of each item's ``k`` best documents (``items``: of ``item_terms``), by rounds over tiers.

    The floor of an item is the k-th best score known so far over all shards. A pair of shard and item is done once no
    document whose score isn't known can reach the floor; only the others are read a tier deeper, the last tier being
    exact. The pairs that lead after the first tier, ``k`` an item at most, go to the last one at once: that lifts the floor.
    """
    n_blocks = items.select("block").distinct().count()
    shards = index.filter("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))).alias("block"))
    if not n_blocks:
        shards = shards.limit(0)
    pairs = shards.join(items, "block").select("shard", "block", "item", "terms", "times")
    done = floors = None
    for upto in range(n_tiers):
        now = materialize(_round(pairs, index, upto, k))
        if not upto:
            lead = materialize(_first(now.filter("exact is not null"), k).select("shard", "block", "item").distinct())
            full = materialize(_round(lead.join(items.drop("block"), "item").select("shard", "block", "item", "terms", "times"), index, n_tiers - 1, k))
            now = now.join(lead, ["shard", "block", "item"], "left_anti").unionByName(full)
        told = now.filter("exact is not null")
        known = told if done is None else told.unionByName(done)
        floor = _first(known.select("item", "doc_id", "score"), k).groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("floor"))
        if floors is not None:
            floor = floor.unionByName(floors).groupBy("item").agg(F.max("floor").alias("floor"))
        floors = materialize(floor)  # a row an item
        most = now.filter("exact is null").join(floors, "item", "left")
        state = materialize(most.select("shard", "block", "item", (F.col("score") >= F.coalesce("floor", F.lit(1))).alias("open")))
        settled = told.filter("exact").join(state.filter("not open").select("shard", "item"), ["shard", "item"], "left_semi")
        done = settled if done is None else done.unionByName(settled)
        left = state.filter("open").select("shard", "block", "item")
        if not left.limit(1).count():
            break
        pairs = left.join(items.drop("block"), "item").select("shard", "block", "item", "terms", "times")
    return _first(done.select("item", "doc_id", "score"), k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """item, rank (from 1), doc_id, score: each item's ``k`` best documents with a score above 0, ties to the smaller id.

    Null texts have no terms; items without terms, or with none that a document has, get no rows. Rows without a doc_id
    count in all figures but aren't found; rows that repeat one are documents each. Items without an id go, and of rows
    that repeat one the least text asks. Texts of any length are read whole; an empty table gives no rows; other columns
    don't matter. Only asked terms are indexed where they are few enough to send to all tasks, else all are.
    """
    asked = item_terms(items)
    wanted = materialize(asked.select(F.explode("terms").alias("term")).distinct())
    n = wanted.count()
    few = [r["term"] for r in wanted.orderBy("term").collect()] if n <= BROADCAST_ROWS else None
    held = materialize(lists(docs, few, shard_rows))
    index = materialize(tiers(held, n_asked=n if few is not None else BROADCAST_ROWS + 1), "tier")
    return search(index, asked, k)


#: DuckDB's brute force.
SQL = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
facts AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, facts GROUP BY term, n_docs),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS impact FROM tf JOIN sizes USING (doc_id) JOIN weights USING (term), facts),
scored AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""
