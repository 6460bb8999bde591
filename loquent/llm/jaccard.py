"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed word n-grams. Equal texts are collapsed to one. MinHash bands bring texts together; inside
a band a forest of links between texts that look alike joins them into cells, so that every two texts over the
threshold share a cell and no group is spelt out in pairs. Inside a cell, in blocks of bounded size, MinHash values
are compared a few at a time and a pair goes once the posterior probability of reaching the threshold falls below
a tolerance; the rest are verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import BROADCAST_ROWS, WORD, discard, materialize, release, runs, sliced, text_or_empty, without
from loquent.llm.components import components

#: Values per band and bands: at a similarity of 0.8 all bands miss with a probability of 1e-9.
ROWS, BANDS = 5, 52
#: Values compared between two rounds of pruning, and the posterior probability below which a pair goes.
STEP, TOLERANCE = 26, 1e-9
#: Texts in one block, and bytes of their n-grams, about.
BLOCK, BLOCK_BYTES = 256, 4_000_000
#: N-grams that are counted at once, each a column of a matrix.
COLUMNS = 8000
#: Estimate of similarity from which two texts of a band share a cell: far enough below any threshold in use.
ALIKE = 0.4
_FIND = re.compile(WORD)
_RNG = np.random.default_rng(20)
_MUL = (_RNG.integers(0, 2**31, ROWS * BANDS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a number, then anew."""

    def __missing__(self, word: str) -> int:
        found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) >= 100_000:
            self.clear()
        self[word] = found
        return found


_WORDS = WordHashes()


def ngrams(text: str, n: int = 5) -> np.ndarray:
    """The sorted set of hashed word n-grams; a text of fewer words is one n-gram, one of none has none."""
    words = _FIND.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(grams: np.ndarray) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _MUL + _ADD).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


@lru_cache
def least_matches(threshold: float) -> tuple[int, ...]:
    """For each number of values compared, the matches below which a pair goes; the prior is even over similarities."""
    s = np.linspace(0.0005, 0.9995, 1000)
    p = s + (1 - s) / 256  # values are compared by their last 8 bits
    out = []
    for n in range(STEP, ROWS * BANDS + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(1, keepdims=True))
        reach = weight[:, s >= threshold].sum(1) / weight.sum(1)
        out.append(int(np.argmax(reach >= TOLERANCE)))
    return tuple(out)


def prune(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Of ``pairs`` of row numbers, those whose posterior probability stays above the tolerance."""
    matches = np.zeros(len(pairs), np.int32)
    for round_, least in enumerate(least_matches(threshold)):
        part = slice(round_ * STEP, (round_ + 1) * STEP)
        matches += (left[pairs[:, 0], part] == right[pairs[:, 1], part]).sum(1, dtype=np.int32)
        stay = matches >= least
        pairs, matches = pairs[stay], matches[stay]
    return pairs


def shared_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many n-grams the two sets of each pair share."""
    if len(pairs) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], np.int64)
    used = np.unique(pairs)
    grams = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, held = np.unique(grams, return_inverse=True, return_counts=True)
    several = held[column] > 1
    column = (np.cumsum(held > 1) - 1)[column[several]]
    owner = owner[several]
    common = np.zeros((len(used), len(used)), np.float32)
    for begin in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        part = (column >= begin) & (column < begin + COLUMNS)
        x = np.zeros((len(used), COLUMNS), np.float32)
        x[owner[part], column[part] - begin] = 1
        common += x @ x.T
    place = np.searchsorted(used, pairs)
    return common[place[:, 0], place[:, 1]].astype(np.int64)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def by_run(keys: list[str], each: Callable[[pa.Table], list[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow on rows sorted by ``keys``: gives each run of equal keys to ``each`` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for table in runs(batches, keys):
            out += each(table)
            if len(out) > 10_000:
                yield made()
                out = []
        yield made()

    return run


def binary_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def forest_of(table: pa.Table) -> list[tuple]:
    """Links between cells (column label) of one band's texts that look alike, each as few as can be."""
    sigs = binary_rows(table.column("sig"), ROWS * BANDS)
    names, cell = np.unique(table.column("label").to_numpy(), return_inverse=True)
    cell, out = cell.astype(np.int64), []
    for c in range(len(cell) - 1):
        if (cell == cell[0]).all():
            break
        other = np.flatnonzero(cell[c + 1 :] != cell[c]) + c + 1
        near = other[np.count_nonzero(sigs[other] == sigs[c], axis=1) >= ALIKE * ROWS * BANDS]
        if len(near):
            joined = np.unique(cell[near])
            out += [(int(names[cell[c]]), int(names[x])) for x in joined]
            cell[np.isin(cell, joined)] = cell[c]
    return out


def shared_bands(sigs: DataFrame) -> DataFrame:
    """id, key and ``n`` for the band keys that ``n`` > 1 texts have. ``sigs``: id, bands.

    Keys are counted before the shuffle, and the join that drops the others has partitions that Spark may split.
    """
    rows = sigs.select("id", F.explode("bands").alias("key"))
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key").select("id", "key", "n")


def meet(rows: DataFrame, sigs: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) between the labels of texts that look alike, for each group of ``rows`` (id, label and ``keys``)."""
    dealt = rows.select("id", "label", *keys).join(sigs.select("id", "sig"), "id").repartition(*keys).sortWithinPartitions(*keys, "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return dealt.mapInArrow(by_run(keys, forest_of, schema), "a bigint, b bigint").distinct()


def first_links(rows: DataFrame, sigs: DataFrame, part_rows: int) -> DataFrame:
    """Links in a fourth of the bands, whose texts meet in parts of about ``part_rows`` that are left apart."""
    slot = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / part_rows)).alias("slot")
    return meet(rows.filter(F.pmod("key", F.lit(4)) == 0).select("id", "key", F.col("id").alias("label"), slot), sigs, ["key", "slot"])


def other_links(rows: DataFrame, sigs: DataFrame, part_rows: int) -> DataFrame:
    """Links between the labels of ``rows`` (id, key, n, label) in all bands that still hold more than one label.

    A band's texts are dealt into slots by label, a frequent label into slots of its own. Each two slots meet in a task
    of their own, unless both hold one and the same label: so a large group of near copies, which the first links
    made one label, isn't gone through in pairs again.
    """
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    several = sizes.groupBy("key").agg(F.count("*").alias("labels")).filter("labels > 1").select("key")
    mixed = rows.join(several, "key").join(sizes, ["key", "label"])
    own = F.xxhash64("label", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / part_rows)))
    slot = F.when(F.col("c") * 2 >= part_rows, own).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("n") / part_rows)))
    mixed = held = materialize(mixed.select("id", "key", "label", slot.alias("slot")))
    slots = mixed.groupBy("key", "slot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    side = lambda x: slots.select("key", F.col("slot").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))
    done = "lo_one = hi_one and lo_two = hi_two and lo_one = lo_two"
    pairs = side("one").join(side("two"), "key").filter(f"one <= two and not ({done})").select("key", "one", "two")
    pairs = pairs.select("key", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("slot"))
    found = materialize(meet(mixed.join(pairs, ["key", "slot"]), sigs, ["key", "one", "two"]))
    discard(held)
    return found


def cells(sigs: DataFrame, part_rows: int = 1000) -> DataFrame:
    """``node`` and ``label``: of all texts that a band joins to another, the cell. ``sigs``: id, sig, bands.

    A fourth of the bands goes first; what they join has one label from then on, and in all bands only texts of
    different labels still meet. So links grow with the texts, not with the square of a group.
    """
    rows = materialize(shared_bands(sigs))
    one = materialize(components(first_links(rows, sigs, part_rows)))
    named = one.select(F.col("node").alias("id"), "label")
    labelled = materialize(rows.join(named, "id", "left").select("id", "key", "n", F.coalesce("label", "id").alias("label")))
    links = other_links(labelled, sigs, part_rows)
    two = materialize(components(links))
    up = two.select(F.col("node").alias("__n"), F.col("label").alias("__up"))
    again = one.join(up, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__up", "label").alias("label"))
    found = materialize(again.unionByName(two.join(one.select("node"), "node", "left_anti")))
    discard(rows, one, labelled, links, two)
    return found


def verified(threshold: float) -> Callable[[pa.Table], list[tuple]]:
    """Of the texts of one pair of blocks: links found for each, and a forest of pairs over the threshold."""

    def each(table: pa.Table) -> list[tuple]:
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        times = table.column("times").to_numpy()
        sigs = binary_rows(table.column("sig"), ROWS * BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if one == two:
            i, j = np.triu_indices(len(a), 1)
            pairs = np.stack([a[i], a[j]], 1)
        else:
            pairs = np.stack([np.repeat(a, len(b)), np.tile(b, len(a))], 1)
        pairs = prune(sigs, sigs, pairs, threshold)
        common = shared_counts(sets, pairs) if len(pairs) else np.zeros(0, np.int64)
        sizes = np.array([len(s) for s in sets])
        either = sizes[pairs].sum(1) - common if len(pairs) else common
        pairs = pairs[common >= threshold * either - 1e-9]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, pairs[:, 0], times[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], times[pairs[:, 0]])
        out = [(int(ids[i]), None, int(links[i])) for i in np.flatnonzero(links)]
        forest = Forest(len(ids))
        return out + [(int(ids[i]), int(ids[j]), None) for i, j in pairs.tolist() if forest.join(i, j)]

    return each


def similar(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ``class_id`` (the least id that links lead to) and ``links``.

    ``links`` counts the other documents with an n-gram Jaccard similarity of ``threshold`` or more, equal texts
    with them. Texts of fewer than ``n`` words are one n-gram; null and empty texts and those of white space have
    no n-grams, no links and a class of their own. Rows that repeat an id are one document, with the least of their
    texts. Rows with a null id and other columns are left out. No rows give none. Texts of any length are read whole; a
    task holds all n-grams of a text at once, as hashes of 8 bytes.
    """
    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text).alias("text"))
    if source.groupBy("id").count().filter("count > 1").limit(1).count():
        source = source.groupBy("id").agg(F.min("text").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, sigs, bands, sizes = [], [], [], []
            for value in batch.column(1):
                words = _FIND.findall(one := value.as_py())
                keys.append(hashlib.blake2b("\n".join(words).encode(), digest_size=16).digest() if words else None)
                least = minhashes(grams := ngrams(one, n))
                sizes.append(len(grams))
                sigs.append(least.astype(np.uint8).tobytes() if words else None)
                bands.append(band_keys(least) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["id", "same", "sig", "bands", "size"])

    signed = materialize(source.mapInArrow(sign, "id bigint, same binary, sig binary, bands array<bigint>, size bigint"))
    member = signed.select("id", "same")
    first = materialize(member.filter("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("times")))
    copies = member.filter("same is not null").join(first, "same").filter("id <> rep")
    reps = without(signed.filter("same is not null"), copies, "id").select("id", "sig", "bands", "size")
    held = cells(reps)
    celled = held.select(F.col("node").alias("id"), F.col("label").alias("cell"))
    release(docs.sparkSession)
    celled = celled.join(reps.select("id", "size"), "id")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("size") / BLOCK_BYTES)).cast("int").alias("m")
    sized = celled.join(first.select(F.col("rep").alias("id"), "times"), "id").join(celled.groupBy("cell").agg(blocks), "cell")
    sized = materialize(sized.select("id", "cell", "times", "m"))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [ngrams(x.as_py(), n) for x in batch.column("text")]
            sigs = pa.array([minhashes(s).astype(np.uint8).tobytes() for s in sets], pa.binary())
            grams = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "cell", "times", "m")], sigs, grams], ["id", "cell", "times", "m", "sig", "grams"])

    small = sized.count() <= BROADCAST_ROWS
    texts = source.join(F.broadcast(sized) if small else sized, "id").select("id", "text", "cell", "times", "m")
    sets = texts.mapInArrow(gram, "id bigint, cell bigint, times bigint, m int, sig binary, grams binary")
    blocks = sets.withColumn("__n", F.col("m"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    blocks = blocks.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    blocks = blocks.select("id", "cell", "block", F.least("block", "__other").alias("one"), F.greatest("block", "__other").alias("two"), "times", "sig", "grams")
    dealt = blocks.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two", "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    found = materialize(dealt.mapInArrow(by_run(["cell", "one", "two"], verified(threshold), schema), "a bigint, b bigint, links bigint"))
    discard(held, sized)
    release(docs.sparkSession)
    classes = components(found.filter("b is not null").select("a", "b"))
    linked = found.filter("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    facts = first.join(linked, first["rep"] == linked["a"], "left").join(classes, first["rep"] == classes["node"], "left")
    facts = materialize(facts.select("same", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links")))
    facts_held, facts = facts, facts.withColumnRenamed("same", "__same")
    named = member.filter("same is not null").join(facts, F.col("same") == F.col("__same")).select("id", "class_id", "links")
    alone = member.filter("same is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    result = materialize(named.union(alone).withColumnRenamed("id", "doc_id"))
    discard(signed, first, found, facts_held)
    return result
