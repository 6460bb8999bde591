"""A gated recurrent language model in numpy, with class-factored softmax, trained by truncated backpropagation.

Spark deals the work: tasks count words, write each document's symbols, train on shards of them from common
parameters that are averaged between rounds, and score whole documents, the state carried from window to window. Words
beyond the model's vocabulary are one symbol, shared among them by their counts over all training documents, so every
text has a probability. Shards are made by hashes and the number of tokens, so scores don't depend on input splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import materialize, runs, sliced, text_or_empty

#: Classes, words in each, units. Symbols: 0 any rare word, in a class of its own; from the next class on the end and
#: the most frequent words.
CLASSES, EACH, UNITS = 32, 32, 16
SYMBOLS = CLASSES * EACH
#: Steps between two cuts of backpropagation, and steps scored at once; documents in one training batch.
WINDOW, SCORED, BATCH = 32, 64, 512
#: Predictions whose probabilities are worked out at once, at most and one step of all documents more.
AT_ONCE = 60_000
#: Logits up to which exponentials are taken as they are; beyond, the greatest of a prediction is taken off first.
STEADY = 60
#: Most frequent words whose counts every task holds; counts of others are joined.
HELD = 100_000
#: Tokens that one task trains on between two averages, about.
SHARD = 1_000_000
RARE, END_SYMBOL = 0, EACH
#: Most frequent words that have a symbol, and the first of these.
OWN, FIRST = SYMBOLS - EACH - 1, EACH + 1


#: Words whose counts are added up at once; bytes of a word up to which it is hashed along with all others.
TALLIED, SHORT = 1 << 21, 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Keeps the first 0 to 8 bytes of a number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """63 bits that stand for each word of all ``texts`` (no nulls), in order, and how many words each text has.

    Words are runs of anything but ASCII white space, A-Z in lower case. They are found and hashed in the bytes of all
    texts at once, eight bytes of every word at a time; the few very long ones one by one.
    """
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n, begins = int(bounds[-1] - bounds[0]), bounds - bounds[0]
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    raw = np.zeros(n + 8, np.uint8)  # eight bytes can be read at each place
    data = raw[:n]
    data[:] = np.frombuffer(texts.buffers()[2], np.uint8, n, int(bounds[0]))
    data += (data - np.uint8(65) < 26).view(np.uint8) << 5
    inside = (data != 32) & (data - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = begins[(begins > 0) & (begins < n)]  # words end where their text does
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    eights = np.ndarray((n + 1,), "<u8", raw, 0, (1,))
    out = size.astype(np.uint64) * _B
    rest = slice(None) if size.max(initial=0) <= 8 else np.arange(len(size))
    for at in range(0, min(int(size.max(initial=0)), SHORT), 8):
        if at:
            rest = rest[size[rest] > at]
        h = out[rest] ^ (eights[start[rest] + at] & _FIRST_BYTES[np.minimum(size[rest] - at, 8)])
        h *= _A
        h ^= h >> np.uint64(32)
        h *= _B
        h ^= h >> np.uint64(29)
        out[rest] = h
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return (out >> np.uint64(1)).view(np.int64), np.diff(np.searchsorted(start, begins))


def word_hash(word: bytes) -> int:
    """63 bits that stand for a word."""
    return int(word_hashes(pa.array([word], pa.binary()))[0][0])


class Model:
    """Parameters as one flat vector, with views by name."""

    SHAPES = {"inputs": (SYMBOLS, 3 * UNITS), "carry": (UNITS, 3 * UNITS), "class_w": (UNITS, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, EACH, UNITS), "word_b": (CLASSES, EACH)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat.astype(np.float32, copy=False), 0
        self.at: dict[str, slice] = {}
        for name, shape in self.SHAPES.items():
            self.at[name] = slice(at, at + int(np.prod(shape)))
            setattr(self, name, self.flat[self.at[name]].reshape(shape))
            at = self.at[name].stop

    @classmethod
    def first(cls, counts: np.ndarray) -> Model:
        """Small random weights, and biases that give each symbol its share of ``counts``."""
        rng = np.random.default_rng(20)
        model = cls(rng.normal(0, 0.1, cls.SIZE))
        share = (counts + 0.5) / (counts + 0.5).sum()
        model.class_b[:] = np.log(share.reshape(CLASSES, EACH).sum(1))
        model.word_b[:] = np.log(share.reshape(CLASSES, EACH)) - model.class_b[:, None]
        return model

    def step(self, x: np.ndarray, h: np.ndarray, gates: np.ndarray | None = None, cand: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states after ``h`` (a column for each text) and inputs ``x``, and what backpropagation needs of the gates.

        That is the two gates and what the third lets through, in rows one below the other, and the candidates; they are
        written to ``gates`` and ``cand`` where these are given.
        """
        gates = np.matmul(self.carry.T, h, out=gates)
        zr = gates[: 2 * UNITS]
        zr += x[: 2 * UNITS]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        cand = np.multiply(zr[UNITS:], gates[2 * UNITS :], out=cand)
        cand += x[2 * UNITS :]
        np.tanh(cand, out=cand)
        after = h - cand
        after *= zr[:UNITS]
        after += cand
        return after, gates, cand

    def columns(self) -> np.ndarray:
        """What each symbol puts into the gates, as a column."""
        return np.ascontiguousarray(self.inputs.T)

    def told(self, h: np.ndarray, symbols: np.ndarray, grads: Model | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of ``symbols`` after states ``h`` (columns); with ``grads``, adds the loss's slopes, and gives that by ``h``.

        The class of rare words has no other symbol, so nothing is to be told inside it. States get a row of ones for the
        biases, and each class writes its columns of one array, so that all else is done once for all classes.
        """
        group = symbols // EACH
        order = np.argsort(group.astype(np.uint16), kind="stable")  # by class, so that each class is one slice
        group, word = group[order], symbols[order] % EACH
        h = np.concatenate((np.take(h, order, axis=1), np.ones((1, len(order)), np.float32)))
        logits = self.classes().T @ h
        out = settle(logits, group, grads is not None)
        bounds = np.searchsorted(group, np.arange(CLASSES + 1))
        inner = bounds[RARE // EACH + 1]  # the rare ones come first
        found = [(c, slice(bounds[c], bounds[c + 1]), slice(bounds[c] - inner, bounds[c + 1] - inner)) for c in np.flatnonzero(np.diff(bounds)).tolist() if c != RARE // EACH]
        words = np.concatenate((self.word_w, self.word_b[:, :, None]), axis=2)
        inside = np.empty((EACH, len(order) - inner), np.float32)
        for c, at, own in found:
            np.matmul(words[c], h[:, at], out=inside[:, own])
        out[inner:] += settle(inside, word[inner:], grads is not None)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        if grads is None:
            return out[back], None
        grads.classes()[:] += h @ logits.T
        slope = self.class_w @ logits
        for c, at, own in found:
            both = inside[:, own] @ h[:, at].T
            grads.word_w[c] += both[:, :UNITS]
            grads.word_b[c] += both[:, UNITS]
            slope[:, at] += self.word_w[c].T @ inside[:, own]
        return out[back], np.take(slope, back, axis=1)

    def classes(self) -> np.ndarray:
        """Weights of the classes and, as the last row, their biases."""
        return self.flat[self.at["class_w"].start : self.at["class_b"].stop].reshape(UNITS + 1, CLASSES)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The natural log probability of each sequence of symbols, all stepping together from window to window."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        sizes = sizes[order]
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        out, h = np.zeros(len(texts)), np.zeros((UNITS, len(texts)), np.float32)
        steps, at, columns = int(sizes.max(initial=0)), 0, self.columns()
        while at < steps:
            counts = np.searchsorted(-sizes, -np.arange(at, min(at + SCORED, steps)), "left")  # those longer come first
            counts = counts[: 1 + int(np.searchsorted(np.cumsum(counts), AT_ONCE))]
            symbols, owners, bounds = laid(flat, begins, at, counts)
            before = np.empty((UNITS, len(symbols)), np.float32)
            for n, a, b in zip(counts.tolist(), bounds, bounds[1:]):
                h = h[:, :n]
                before[:, a:b] = h
                h = self.step(np.take(columns, symbols[a:b], axis=1), h)[0]
            out += np.bincount(owners, self.told(before, symbols)[0], minlength=len(texts))
            at += len(counts)
        back = np.empty(len(texts))
        back[order] = out
        return back

    def train(self, texts: list[np.ndarray], rate: float) -> int:
        """Adam over windows of batches of sequences; returns the symbols seen."""
        first, second, change, step = *np.zeros((3, self.SIZE), np.float32), 0
        texts = sorted(texts, key=len, reverse=True)
        many = min(BATCH, max(32, len(texts) // 16))  # few texts: smaller batches, so that there are steps enough
        for b in range(0, len(texts), many):
            batch = texts[b : b + many]
            sizes = np.array([len(t) for t in batch])
            flat, begins = np.concatenate(batch).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1]))
            h = np.zeros((UNITS, len(batch)), np.float32)
            for at in range(0, int(sizes[0]), WINDOW):
                counts = np.searchsorted(-sizes, -np.arange(at, min(at + WINDOW, int(sizes[0]))), "left")  # those that go on come first
                slope, h = self.window(flat, begins, at, counts, h)
                step += 1
                np.subtract(slope, first, out=change)
                change *= 0.1
                first += change
                np.multiply(slope, slope, out=change)
                change -= second
                change *= 0.01
                second += change
                np.divide(second, 1 - 0.99**step, out=change)
                np.sqrt(change, out=change)
                change += 1e-6
                np.divide(first, change, out=change)
                change *= rate / (1 - 0.9**step)
                self.flat -= change
        return sum(map(len, texts))

    def window(self, flat: np.ndarray, begins: np.ndarray, at: int, counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean loss's slopes over one window, and the states after it. Slopes go back to its beginning, not beyond.

        The steps from ``at`` on have ``counts`` sequences each; ``begins`` says where those lie in ``flat``.
        """
        symbols, _, bounds = laid(flat, begins, at, counts)
        x, before = np.take(self.columns(), symbols, axis=1), np.empty((UNITS, len(symbols)), np.float32)
        gates, cand = np.empty_like(x), np.empty_like(before)
        steps = list(zip(counts.tolist(), bounds, bounds[1:]))
        for n, a, b in steps:
            h = h[:, :n]
            before[:, a:b] = h
            h = self.step(x[:, a:b], h, gates[:, a:b], cand[:, a:b])[0]
        grads = Model(np.zeros(self.SIZE, np.float32))
        slopes = self.told(before, symbols, grads)[1]
        # what each gate's input does to a state, so that going back a step is a product with the state's slopes
        z, r, g = gates.reshape(3, UNITS, -1)
        direct = (1 - z) * (1 - cand * cand)
        factors = np.stack(((before - cand) * z * (1 - z), direct * r * g * (1 - r), direct * r))
        dg, after = x.reshape(3, UNITS, -1), np.empty_like(before)  # x is not read again
        d = np.zeros((UNITS, 0), np.float32)
        for n, a, b in steps[::-1]:
            if d.shape[1] < n:
                d = np.concatenate((d, np.zeros((UNITS, n - d.shape[1]), np.float32)), axis=1)
            after[:, a:b] = d
            np.multiply(factors[:, :, a:b], d, out=dg[:, :, a:b])
            d *= z[:, a:b]
            d += self.carry @ x[:, a:b]
            d += slopes[:, a:b]
        grads.carry += before @ x.T
        np.multiply(after, direct, out=dg[2])
        order = np.argsort(symbols.astype(np.uint16), kind="stable")
        distinct, begin = np.unique(symbols[order], return_index=True)
        grads.inputs[distinct] += np.add.reduceat(np.take(x, order, axis=1), begin, axis=1).T
        return np.clip(grads.flat / len(symbols), -1, 1), h


def settle(logits: np.ndarray, picked: np.ndarray, slopes: bool) -> np.ndarray:
    """Log probabilities of the row ``picked`` in each column of ``logits``; these become the loss's slopes or are used up."""
    if max(logits.max(initial=0), -logits.min(initial=0)) > STEADY:
        logits -= logits.max(0)
    at = picked * logits.shape[1] + np.arange(logits.shape[1])
    out = np.take(logits, at)
    np.exp(logits, out=logits)
    total = logits.sum(0)
    out -= np.log(total)
    if slopes:
        logits /= total
        logits.reshape(-1)[at] -= 1
    return out


def laid(flat: np.ndarray, begins: np.ndarray, at: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Symbols of the steps from ``at`` on, which have ``counts`` sequences each, whose they are, and where each step begins and ends."""
    bounds = np.concatenate(([0], np.cumsum(counts)))
    steps = np.repeat(np.arange(len(counts)), counts)
    owners = np.arange(bounds[-1]) - bounds[steps]
    return flat[begins[owners] + at + steps], owners, bounds.tolist()


def held_out(id_col: Column) -> Column:
    """Whether the remainder of the id's CRC-32 by 7 is 2; no for null ids."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(7)) == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n`` over all of ``docs`` (column text)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            words = pc.value_counts(pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            return pa.RecordBatch.from_arrays([words.field("values"), words.field("counts")], ["word", "n"])

        for batch in sliced(batches):
            found.append(word_hashes(batch.column(0))[0])
            if sum(map(len, found)) > TALLIED:
                yield made()
                found.clear()
        yield made()

    return docs.select("text").mapInArrow(tally, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[list[int], np.ndarray]:
    """Hashes and counts of the most frequent words, ``most`` or fewer: all words that occur as often as some number.

    That number comes from a histogram of counts, exact up to 4096 and in steps of one hundredth beyond, so only the
    histogram and the words found reach the driver.
    """
    bucket = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2(F.col("n") / 4096) * 64)).cast("int")
    sizes = {r["b"]: r["words"] for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("words")).collect()}
    total, least = 0, None
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    if least is None:
        return [], np.zeros(0)
    found = counts.filter(bucket >= least).collect()  # bounded by most
    found.sort(key=lambda r: (-r["n"], r["word"]))
    return [r["word"] for r in found], np.array([r["n"] for r in found], np.float64)


def trained(docs: DataFrame, model: Model, rounds: int, shards: int) -> Model:
    """``model`` after ``rounds`` rounds, each over another part of ``docs`` (symbols, key): together all of them, once.

    Parts and shards are dealt by ``key``. In a round the texts of each shard, whole, train a model of their own from
    the common parameters; these are averaged by the symbols that they saw.
    """
    for turn in range(rounds):
        flat, rate = model.flat.copy(), 0.02 / (1 + turn)

        def fit(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, rate: float = rate) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(Model.SIZE), 0
            for shard in runs(batches, ["shard"]):
                own = Model(flat.copy())
                n = own.train([np.frombuffer(x, np.uint16) for x in shard.column("symbols").to_pylist()], rate)
                total += own.flat.astype(np.float64) * n
                seen += n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(Model.SIZE)), pa.array(total), pa.array(np.full(Model.SIZE, seen))], ["at", "value", "seen"])

        shard = F.pmod(F.shiftright("key", 8), F.lit(shards)).alias("shard")
        part = docs.filter(F.pmod("key", F.lit(rounds)) == turn).select(shard, "key", "symbols")
        part = part.repartition(shards, "shard").sortWithinPartitions("shard", "key", "symbols")
        rows = part.mapInArrow(fit, "at bigint, value double, seen bigint").groupBy("at").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).toPandas()  # one row a parameter
        flat = model.flat.copy()
        flat[rows["at"].to_numpy()] = rows["value"].to_numpy() / rows["seen"].to_numpy()
        model = Model(flat)
    return model


def score(docs: DataFrame, rounds: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Learns from rows that aren't held out; the network sees each of them once. Words are runs of anything but ASCII
    white space, A-Z in lower case; each text has one end more. The base is the add-one unigram model. Null and empty
    texts are an end alone; texts of any length are read and scored whole. Null ids are never held out; rows that
    repeat count as often in training and score alike; other columns are left out. No training rows: all words are
    unknown and the base score is 0.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    learnt = source.filter(~F.col("held_out"))
    counts = materialize(word_counts(learnt))
    ends = learnt.select("held_out").count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_types = sums["n"] + ends, sums["v"] + (ends > 0)
    words, held = most_frequent(counts, HELD)
    words = np.array(words, np.int64)
    own = held[:OWN]
    rare = n_tokens - ends - own.sum()
    shares = np.zeros(SYMBOLS)
    shares[END_SYMBOL], shares[RARE], shares[FIRST : FIRST + len(own)] = ends, rare, own
    log_held = np.log10(held + 1)
    rare_mass = float(rare + (n_types - (ends > 0) - len(own)) + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's symbols, the sums that its held words give, and its other words, of a thousand texts at once."""
        ranks = pa.array(words)
        for batch in sliced(batches):
            found, sizes = word_hashes(batch.column(1))
            many, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            code = pc.fill_null(pc.index_in(pa.array(found), ranks), -1).to_numpy()
            known, small = np.flatnonzero(code >= 0), np.flatnonzero(code >= OWN)
            n_known, n_small = (np.bincount(owner[x], minlength=many) for x in (known, small))
            logs, rare_logs = (np.bincount(owner[x], log_held[code[x]], many).astype(np.float64) for x in (known, small))
            bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
            symbols = np.full(bounds[-1], END_SYMBOL, np.uint16)
            symbols[np.arange(len(owner)) + owner] = np.where((code >= 0) & (code < OWN), code + FIRST, RARE)
            symbols = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(symbols)])
            other = np.flatnonzero(code < 0)
            other = other[np.lexsort((found[other], owner[other]))]
            word, text = found[other], owner[other]
            begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(other)), bool), (word[1:] != word[:-1]) | (text[1:] != text[:-1]))))
            items = pa.StructArray.from_arrays([pa.array(word[begin]), pa.array(np.diff(begin, append=len(other)))], ["word", "tf"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begin], np.arange(many + 1)), pa.int32()), items)
            columns = [sizes + 1, n_known + (ends > 0), logs + np.log10(ends + 1), rare_logs, n_small + sizes - n_known]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *map(pa.array, columns), symbols, rest], NAMES)

    NAMES = ["doc_id", "held_out", "key", "twin", "n_tokens", "n_known", "logs", "rare_logs", "n_rare", "symbols", "rest"]
    schema = f"doc_id {kind}, held_out boolean, key bigint, twin bigint, n_tokens bigint, n_known bigint, logs double, rare_logs double, n_rare bigint, symbols binary, rest array<struct<word:bigint,tf:bigint>>"
    rows = source.select("doc_id", "text", "held_out", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text").alias("twin"))  # 128 bits stand for a row
    made = materialize(rows.mapInArrow(encode, schema))
    model = trained(made.filter(~F.col("held_out")), Model.first(shares), rounds, -(-int(n_tokens) // (SHARD * max(1, rounds))) or 1)
    flat = model.flat

    one_each = made.select("key", "twin", "rest")
    if made.groupBy("key", "twin").count().filter("count > 1").limit(1).count():
        one_each = one_each.dropDuplicates(["key", "twin"])
    words_ = one_each.select("key", "twin", F.explode("rest").alias("w")).select("key", "twin", "w.word", "w.tf")
    found = words_.join(counts, "word").groupBy("key", "twin").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more"), F.sum("tf").alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(flat.copy())
        for batch in batches:
            told = model.score([np.frombuffer(x, np.uint16) for x in batch.column(batch.num_columns - 1).to_pylist()]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(told)], [*NAMES[:-2], "told"])

    told = made.drop("rest").mapInArrow(run, schema[: schema.index(", symbols")] + ", told double")
    whole = told.join(found, ["key", "twin"], "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(n_tokens + n_types + 1)))).alias("base_score"),
        (F.col("told") + F.col("rare_logs") + more - F.col("n_rare") * F.lit(float(np.log10(rare_mass)))).alias("score"),
    )
