"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of the target (labelled good) and one of the raw text (all documents),
give each document the logarithm of its importance weight: the sum over its n-grams of how much likelier the target
has them. Gumbel top-k over these weights samples a stated share of the documents without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import materialize, sliced, text_or_empty

#: Buckets of each model: word n-grams and n-grams of the shapes of words.
BUCKETS = 1 << 14
_K = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = zlib.crc32(b"=")


def shape(word: str) -> str:
    """A word with runs of capitals, small letters and digits as A, a and 9, runs of a sign as two of it."""
    out = []
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind or (kind not in "Aa9" and out[-2:-1] != [kind]):
            out.append(kind)
    return "".join(out)


class Shapes(dict):
    """Hashes of a word and of its shape, kept up to a number, then anew."""

    def __missing__(self, word: str) -> tuple[int, int]:
        found = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass")))
        if len(self) >= 100_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_SHAPES = Shapes()


def buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the one- and two-grams of words, and of shapes; a word that repeats the one before has its own shape."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.array([_SHAPES[w] for w in words], np.uint64)
    same = np.concatenate(([False], both[1:, 0] == both[:-1, 0]))
    both[same, 1] = _AGAIN
    out = []
    for h in (both[:, 0], both[:, 1]):
        pairs = (h[:-1] * _K) ^ (h[1:] + np.uint64(7))
        grams = np.concatenate((h, pairs)) * _K
        out.append((grams >> np.uint64(50)).astype(np.int64))
    return out[0], out[1]


def sample_labels(labels: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """About ``rows`` labelled ids at most, chosen by a hash of the id, with ``good`` 0 or 1; and the share of good ones of all labelled."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("good"))
    all_ = known.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    share = min(1.0, rows / max(1, all_["n"]))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))
    return known.filter(chosen), (all_["good"] or 0) / max(1, all_["n"])


def models(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Of words and of shapes, by bucket: how much likelier the target model has it than the raw model, as logarithms."""
    marked = docs.join(F.broadcast(sample), "doc_id", "left").select("text", (F.coalesce("good", F.lit(0)) > 0).alias("good"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2 * BUCKETS), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                words, shapes = buckets(text.as_py())
                found = np.bincount(np.concatenate((words, shapes + BUCKETS)), minlength=2 * BUCKETS)
                counts[0] += found
                if good:
                    counts[1] += found
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])

    found = marked.mapInArrow(tally, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, 2 * BUCKETS))
    for row in found.collect():  # at most one row a bucket
        counts[:, row["bucket"]] = row["raw"], row["target"]
    out = []
    for part in (counts[:, :BUCKETS], counts[:, BUCKETS:]):
        p = (part + 0.5) / (part.sum(1, keepdims=True) + 0.5 * BUCKETS)
        out.append(np.log(p[1]) - np.log(p[0]))
    return np.stack(out)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The value that exactly ``k`` rows reach, or the least that no fewer do, without sorting: by ever finer counts."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    above = 0
    for _ in range(12):
        width = (high - low) / bins
        if not width > 0:
            break
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("at")
        counts = {r["at"]: r["n"] for r in df.filter(F.col(column).between(low, high)).groupBy(at).agg(F.count("*").alias("n")).collect()}  # a row a bin
        for i in sorted(counts, reverse=True):
            if above + counts[i] >= k:
                break
            above += counts[i]
        if above + counts[i] == k or counts[i] == 1:
            low = df.filter(F.col(column).between(low, high)).groupBy(at).agg(F.min(column).alias("least")).filter(F.col("at") == i).first()["least"]
            break
        span = df.filter(F.col(column).between(low, high)).groupBy(at).agg(F.min(column).alias("a"), F.max(column).alias("b")).filter(F.col("at") == i).first()
        low, high = span["a"], span["b"]
    return low


def classify(docs: DataFrame, labels: DataFrame, rows: int = 10_000, share: float | None = None, seed: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ``log_weight``, ``gumbel_key`` and ``kept``.

    ``log_weight`` is the summed log ratio of target to raw over the n-grams of words and those of shapes. Kept is
    the ``share`` of the documents (rounded; by default that of good rows among all labelled ones) with the greatest
    log_weight + Gumbel noise: a sample without replacement by importance weight. The noise is seeded by a hash of
    the id, so reruns agree; of equal keys all stay. The target model learns from the good rows among about ``rows``
    labelled rows at most, the raw model from all documents.

    Null and empty texts have weight 0, texts of any length are read whole. Rows that repeat are kept or not alike;
    null ids are never labelled. Without labels of both kinds all documents are kept. Other columns are left out.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    sample, good = sample_labels(labels, rows)
    sample = materialize(sample)
    told = {r["good"] for r in sample.select("good").distinct().collect()} == {0, 1}
    kind = dict(source.dtypes)["doc_id"]
    ratios = models(source, sample) if told else np.zeros((2, BUCKETS))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = []
            for value in batch.column(1):
                words, shapes = buckets(value.as_py())
                x.append(float(ratios[0][words].sum() + ratios[1][shapes].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["doc_id", "log_weight"])

    weighed = source.mapInArrow(weigh, f"doc_id {kind}, log_weight double")
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    scored = materialize(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit))))
    if not told:
        return scored.withColumn("kept", F.lit(True))
    cut = kth_largest(scored, "gumbel_key", round(scored.count() * (good if share is None else share)))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(cut) if cut is not None else F.lit(False))
