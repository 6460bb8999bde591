"""Spelling variants: words one edit apart, found in dictionaries sorted forwards and backwards.

One edit leaves a half of a word intact, the first or the last. So words that may be near share a prefix of half their
length, and lie together in a dictionary in order, or a suffix, and lie together in one of reversed words. Blocks of
words that share a half are range-scanned; a block with too many words is cut again: of what its words don't share yet,
an edit leaves a half intact too. A pair is told in the one block that its common prefix names, so none comes twice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import discard, join_small, materialize, sliced, text_or_empty

#: Letters of words, as bytes of Latin-1, A-Z in lower case; all else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Bytes of pairs that are compared at once.
AT_ONCE = 1 << 24


def corrupted(word: bytes, prefix: int, every: int) -> bytes:
    """``word`` (Latin-1) without one letter, if the checksum that ``prefix`` begins says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def dictionary(docs: DataFrame, least: int = 7, occurrences: int = 2, every: int = 31, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: the distinct results of at least ``least`` letters and ``occurrences`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; where ``every`` divides the CRC-32 of
    ``<id>:<word>``, the letter at that number modulo the length goes. Each batch of texts sends on its own counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            total: Counter[bytes] = Counter()
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                words = Counter(body.as_py().encode("latin-1", "replace").translate(LETTERS).split())
                for word, n in words.items():
                    if len(word) >= least:
                        made = corrupted(word, prefix, every)
                        if len(made) >= least:
                            total[made] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    parts = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``block``: what the words of a block share, ``p`` letters in front and ``q`` behind; these backwards."""
    kept = F.when(F.col("q") > 0, F.reverse(F.expr("right(word, q)"))).otherwise("")
    return rows.withColumn("block", F.concat_ws(":", "size", "p", "q", F.concat(F.expr("left(word, p)"), F.lit("|"), kept)))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: in the block of the words that share the first half of what is between too, and of the last half."""
    cut = F.col("p") + F.floor((F.col("size") - F.col("p") - F.col("q")) / 2).cast("int")
    first = F.struct(cut.alias("p"), F.col("q").alias("q"))
    last = F.struct(F.col("p").alias("p"), (F.col("size") - cut).alias("q"))
    return rows.withColumn("__h", F.explode(F.array(first, last))).select("word", "n", "size", F.col("__h.p").alias("p"), F.col("__h.q").alias("q"))


def blocks(words: DataFrame, least: int = 7, most: int = 256) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (word, n, size, p, q, block) of blocks that hold ``most`` words or have one letter left, and tables to discard.

    size: the length of the shorter word of a pair; each word takes part with its own length and, as the longer one,
    with one less. Blocks are counted, and only those with more rows than ``most`` are cut, so no task scans a hot one.
    Rounds are at most the logarithm of the longest word.
    """
    n_letters = F.length("word")
    sizes = F.filter(F.array(n_letters, n_letters - 1), lambda s: s >= least)
    rows = words.select("word", "n", F.explode(sizes).alias("size"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    done, scratch = [], []
    while True:
        now = materialize(_keyed(_halves(rows)))
        scratch.append(now)
        counts = now.groupBy("block").agg(F.count("*").alias("rows"), F.max(F.col("size") - F.col("p") - F.col("q")).alias("left"))
        large = materialize(counts.filter((F.col("rows") > most) & (F.col("left") > 1)).select("block"))
        scratch.append(large)
        n = large.count()
        if not n:
            done.append(now)
            break
        marked = join_small(now, large.withColumn("cut", F.lit(True)), "block", n, "left")
        done.append(marked.filter("cut is null").drop("cut"))
        rows = marked.filter("cut").select("word", "n", "size", "p", "q")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, scratch


def _between(words: list[bytes], p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What lies between the shared ends of each word, forwards and backwards, padded with zeros."""
    parts = [w[a : len(w) - b] for w, a, b in zip(words, p.tolist(), q.tolist())]
    width = max(map(len, parts), default=0) + 1
    join = lambda xs: np.frombuffer(b"".join(x.ljust(width, b"\0") for x in xs), np.uint8).reshape(len(xs), width)
    return join(parts), join([x[::-1] for x in parts])


def near_pairs(words: list[bytes], size: np.ndarray, p: np.ndarray, q: np.ndarray, block_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows one edit apart that this block has to tell. Rows of a block lie together, the shorter words first."""
    length = np.array([len(w) for w in words])
    mid, rev = _between(words, p, q)
    between = size - p - q
    partners = np.where(length == size, block_end - np.arange(len(words)) - 1, 0)
    ends = np.cumsum(partners)
    step = max(1, AT_ONCE // (mid.shape[1] * 4))
    for begin in range(0, int(ends[-1]) if len(ends) else 0, step):
        pair = np.arange(begin, min(begin + step, int(ends[-1])))
        i = np.searchsorted(ends, pair, side="right")
        j = i + 1 + pair - (ends[i] - partners[i])
        other = mid[i] != mid[j]
        common = other.argmax(1)  # two words differ somewhere, in a pad if nowhere else
        alike = length[i] == length[j]
        fits = np.where(alike, other.sum(1) == 1, False)
        longer = np.flatnonzero(~alike)
        behind = (rev[i[longer]] != rev[j[longer]]).argmax(1)
        fits[longer] = common[longer] + behind >= between[i[longer]]
        fits &= (q[i] == 0) | (common < between[i])  # else the block of the longer common prefix tells it
        yield i[fits], j[fits]


def neighbours(rows: DataFrame) -> DataFrame:
    """word, n_near and ``best`` (-n and word of the near word of largest n, ties to the smallest) of words with near ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            last = int(edges(table)[-1])  # its block may go on
            if last:
                yield told(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield told(pa.Table.from_batches(held))

    def edges(table: pa.Table) -> np.ndarray:
        """Where blocks begin."""
        code = table.column("block").combine_chunks().dictionary_encode().indices.to_numpy()
        return np.flatnonzero(np.diff(code, prepend=-1))

    def told(table: pa.Table) -> pa.RecordBatch:
        begins = edges(table)
        rows = np.diff(begins, append=table.num_rows)
        several = np.repeat(rows, rows) > 1
        rows = rows[rows > 1]
        table = table.filter(pa.array(several))
        texts = table.column("word").to_pylist()
        words = [w.encode("latin-1") for w in texts]
        n, size, p, q = (table.column(c).to_numpy() for c in ("n", "size", "p", "q"))
        found = list(near_pairs(words, size, p, q, np.repeat(np.cumsum(rows), rows)))
        one, two = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        one, two = np.concatenate([one, two]), np.concatenate([two, one])
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place[two], -n[two], one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.diff(one, prepend=-1))
        columns = [pa.array([texts[i] for i in one[first]], pa.string()), pa.array(np.diff(first, append=len(one)), pa.int64()), pa.array(-n[two[first]], pa.int64()), pa.array([texts[i] for i in two[first]], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "less", "near"])

    laid = rows.repartitionByRange("block").sortWithinPartitions("block", F.length("word"), "word")
    parts = laid.mapInArrow(scan, "word string, n_near bigint, less bigint, near string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word with a form (columns word, form), from form to form to the last.

    A form has ten times the occurrences of its word, so there are no cycles; pointers double each round.
    """
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.filter("moved").limit(1).count():
        above = now.select(F.col("word").alias("root"), F.col("root").alias("__up"))
        met = join_small(now.drop("moved"), above, "root", now.count(), "left")
        new = materialize(met.select("word", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved")))
        discard(now)
        now = new
    return now.drop("moved")


def variants(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10, every: int = 31, most: int = 256, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word of ``dictionary`` with the word that it is a variant of: word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced letter parts them; the form is the near word of largest n, ties
    to the smallest in code-point order, where that is at least ``times`` the word's n. Null texts are empty, a null id
    counts as an empty one, rows that repeat an id count each; texts and words of any length are read whole; other
    columns don't matter, and an empty table or one without such words gives no rows. Tables of words are merged: their
    files compress so well that Spark would take them for small and broadcast them.
    """
    words = materialize(dictionary(docs, least, occurrences, every, id_col, text))
    rows, scratch = blocks(words, least, most)
    near = materialize(neighbours(rows))
    discard(*scratch)
    both = words.join(near.hint("merge"), "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    named = materialize(both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    last = roots(named.filter("form is not null"))
    return named.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
