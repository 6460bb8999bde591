"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes look-alike letters and digits put for letters. Terms are whole words or beginnings of words, with
weights learnt from labelled rows; an occurrence inside an exception phrase doesn't count. The weights found are
normalised by the length of the text, and a logistic curve of one variable makes a score between 0 and 1 of that.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import materialize, text_or_empty

# Letters that look like Latin ones, and what they look like.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏвкмнтαεικνορτυχ", "aeopcyxijsdhlbkmhtaeiknoptux"))
# Signs put for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum")

_FULLWIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
_TABLE = str.maketrans(LOOKALIKES) | _FULLWIDTH | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_SIGNS = str.maketrans(SUBSTITUTES)
# a run is tried at its beginning alone, and not in parts, so that a long one costs its length
_SWAPPED = re.compile(r"(?<![013457@$!])[013457@$!]++(?=[^\W\d_])|(?<=[^\W\d_])[013457](?![\w])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes undone: a run of signs right before a letter, or one digit at a word's end."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    return _SWAPPED.sub(lambda m: m[0].translate(_SIGNS), text)


@dataclass
class Lexicon:
    """Terms with weights, whole words or, ending with *, beginnings; the curve's slope and offset."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    slope: float = 1.0
    offset: float = -1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        parts: dict[str, list] = {}
        for term, weight in self.weights.items():
            parts.setdefault(term.rstrip("*"), [0.0, 0.0, False])[int(term.endswith("*"))] = weight
        for phrase in self.exceptions:
            parts.setdefault(phrase, [0.0, 0.0, False])[2] = True
        for part, values in parts.items():
            found.add_word(part, (len(part), *values))
        if not parts:
            return None
        found.make_automaton()
        return found


def weigh(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, int]:
    """The summed weights of the words that match, each with its heaviest term, and the number of words."""
    text = fold(text)
    n_words = text.count(" ") + text.count("\n") + 1
    if automaton is None:
        return 0.0, n_words
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, word, stem, phrase) in automaton.iter(text):
        start, after = end - length + 1, end + 1
        if start and text[start - 1].isalpha():
            continue
        ends = after == len(text) or not text[after].isalpha()
        if phrase and ends:
            excused.append((start, after))
        weight = max(stem, word if ends else 0.0)
        if weight:
            best[start] = max(best.get(start, 0.0), weight)
    for start, after in excused:
        for at in [x for x in best if start <= x < after]:
            del best[at]
    return sum(best.values()), n_words


def normalised(total: float, n_words: int) -> float:
    return math.log1p(100 * total / (n_words + 20))


def terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    stems = {f"{w[:n]}*" for w in words for n in (4, 5, 6) if len(w) > n}
    return {w for w in words if len(w) > 2} | stems


def held_out(id_col: Column) -> Column:
    """Whether the remainder of the id's CRC-32 by 5 is 0; no for null ids."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at most of labelled text, none of a held-out id, chosen by a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # bounded by rows
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 10_000, max_terms: int = 3000, support: float = 0.01, odds: float = 6.0, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from about ``rows`` labelled rows at most, whatever the number of documents.

    Texts that share the least hash of their five-word runs count once, so that copies don't lend weight to their
    words. A term needs a share ``support`` of the toxic texts and surely ``odds`` times the share of the others; the
    ``max_terms`` heaviest stay. Without labels of both kinds the lexicon is empty and all scores are low.
    """
    sample = labelled(docs, labels, rows)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(0):
                words = text.as_py().split()
                keys.append(min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), batch.column(1)], ["key", "text", "toxic"])

    families = sample.mapInArrow(keyed, "key bigint, text string, toxic int").groupBy("key").agg(F.max_by("text", F.struct("toxic", "text")).alias("text"), F.max("toxic").alias("toxic"))
    texts = materialize(families.select("text", "toxic"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found[toxic > 0].update(terms_of(text.as_py()))
        terms = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], ["term", "hits", "misses"])

    sizes = texts.agg(F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    toxic, other = sizes["t"], sizes["n"] - sizes["t"]
    if not toxic or not other:
        return Lexicon({}, exceptions)
    counted = texts.mapInArrow(tally, "term string, hits bigint, misses bigint").groupBy("term").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    ratio = ((F.col("hits") + 0.5) / (toxic + 1)) / ((F.col("misses") + 0.5) / (other + 1))
    spread = F.sqrt(1 / (F.col("hits") + 0.5) + 1 / (F.col("misses") + 0.5))
    weight = F.log(ratio) - 1.64 * spread  # the lower end of what the counts allow
    heavy = counted.withColumn("weight", weight).filter((F.col("hits") >= max(3, support * toxic)) & (F.col("weight") >= math.log(odds)))
    chosen = heavy.orderBy(F.desc("weight"), "term").limit(max_terms).collect()  # bounded by max_terms
    lexicon = Lexicon({r["term"]: r["weight"] for r in chosen}, exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = [normalised(*weigh(t.as_py(), automaton)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    pairs = texts.mapInArrow(measured, "x double, toxic int").collect()  # bounded by rows
    order = sorted((r["x"], float(r["toxic"] > 0)) for r in pairs)
    x, y = np.array([a for a, _ in order]), np.array([b for _, b in order])
    lexicon.slope, lexicon.offset = fit_curve(x, y)
    return lexicon


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Logistic regression on one variable by Newton's method, with a small penalty so that it always ends."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``hits`` (summed weights), ``n_words`` and ``score`` from 0 to 1.

    Depends on the text alone. Null and empty texts score as a text without terms; texts of any length are read whole;
    rows and ids, null ones too, stay as they are, and equal texts score alike; other columns are left out. No rows
    give none.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [weigh(t.as_py(), automaton) for t in batch.column(1)]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.slope * normalised(*f) + lexicon.offset)))) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "hits", "n_words", "score"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, hits double, n_words bigint, score double")
