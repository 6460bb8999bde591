"""Suffix-array dedup: bytes covered by long strings that an earlier document has too.

Every string of 50 bytes holds 35 runs of 16 bytes; the one of least hash, its anchor, depends on the string alone.
So equal strings have equal anchors, and a document is cut into few contexts: the bytes around one anchor that hold
all strings it stands for. Only contexts whose anchor is in several texts go on. Equal contexts are settled by the
least document that has them. For the different contexts of one anchor an enhanced suffix array is scanned with a
stack: intervals of a common prefix that can't be extended to the left are the maximal repeats, and each has all
its occurrences, so the least document among them is known for every string. Where an anchor has very many contexts
they are dealt into blocks, and the strings of the blocks, one each, meet once more.

Contexts count as equal if the 64-bit hashes of their anchor and of all their bytes both agree; texts do by their MD5.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import discard, materialize, release, sliced, text_or_empty

#: Bytes of an anchor. With it, strings of 50 bytes have 35 anchors to choose from.
GRAM = 16
#: Longer anchors, for those that more contexts have than meet in one suffix array.
LONGER = (32, 44)
BLOCK = 1000
#: Bytes of a text that anchors are looked for in at once: places have 28 bits.
PIECE = 1 << 27
#: Bytes of texts whose anchors are looked for together, about, and powers that are kept for hashes of their parts.
TOGETHER = 1 << 16
#: Texts looked at together for anchors that very many texts have, how many make one hot, and salts that spread its rows.
LOOK, HOT, SALTS = 2000, 20, 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS = np.uint64((1 << 28) - 1)
#: The last bits of an anchor's hash are left for its salt, so that a row is sorted by one number.
_SALT = np.uint64(SALTS - 1)


def gram_hashes(raw: bytes, gram: int = GRAM) -> np.ndarray:
    """Hashes of the runs of ``gram`` bytes (16 or more), from the words of eight bytes that each is made of."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).copy()  # at every byte
    words ^= words >> np.uint64(31)
    words *= _B
    h = words[:n].copy()
    moved = np.empty_like(h)
    for at in [*range(8, gram - 8, 8), gram - 8]:
        h ^= np.right_shift(h, np.uint64(29), out=moved)
        h *= _A
        h += words[at : at + n]
    h ^= np.right_shift(h, np.uint64(32), out=moved)
    h *= _B
    h ^= np.right_shift(h, np.uint64(29), out=moved)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def least_runs(raw: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``raw``, and for each string of ``length`` bytes the place of its run of least hash, the first of equal ones."""
    width = length - gram + 1
    h = gram_hashes(raw, gram)
    if len(h) < width:
        return h, np.zeros(0, np.int64)
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    return h, (sliding_min(key, width) & _POS).astype(np.int64)


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch of strings with one anchor: its hash, without the last bits, and the first and last place where a string starts."""
    found = []
    for begin in range(0, max(1, len(raw) - length + 1), PIECE):  # pieces overlap so that each string lies in one
        h, at = least_runs(raw[begin : begin + PIECE + length - 1] if len(raw) > PIECE else raw, length)
        edge = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate((np.zeros(min(1, len(at)), np.int64), edge))
        last = np.concatenate((edge - 1, np.full(min(1, len(at)), len(at) - 1)))
        found.append((h[at[first]] & ~_SALT, begin + first, begin + last))
    return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]


def chunks(texts: list[bytes], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Where runs of ``texts`` of about ``most`` bytes (``TOGETHER``) begin and end."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > (most or TOGETHER):
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if texts:
        yield begin, len(texts)


def anchors_of(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, and the ``anchors`` of all: their hashes, first and last places in that one, and whose each is."""
    raw = b"".join(texts)
    if len(texts) == 1:
        found = anchors(raw, length)
        return raw, *found, np.zeros(len(found[0]), np.int64)
    ends = np.cumsum([len(t) for t in texts])
    h, at = least_runs(raw, length)
    mark = np.ones(len(at), bool)
    mark[1:] = at[1:] != at[:-1]
    edge = np.concatenate((ends, ends - length + 1))  # from here on, strings are of another text or of two
    mark[edge[(edge >= 0) & (edge < len(at))]] = True
    first = np.flatnonzero(mark)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    owner = np.searchsorted(ends, first, "right")
    kept = first + length <= ends[owner]
    first, last = first[kept], last[kept]
    return raw, h[at[first]] & ~_SALT, first, last, owner[kept]


_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_A), -1, 2**64))


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers from 0 to ``n``, and their inverses."""
    return tuple(np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, x)))) for x in (_A, _INVERSE))


@cache
def kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers_to(2 * TOGETHER)


def stretch_hashes(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each begin to its end, by sums of powers, so that places don't matter."""
    n = len(raw)
    powers, back = kept_powers() if n <= 2 * TOGETHER else powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * powers[:n], out=sums[1:])
    h = (sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64) * _B
    h ^= h >> np.uint64(29)
    h *= _B
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def suffix_order(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes from ``starts`` to ``ends`` in order, and the common prefix of each with the one before it.

    From each end on, up to ``width`` bytes from its start, ``raw`` holds zeros or is over.
    """
    padded = np.concatenate((raw, np.zeros(width, np.uint8)))
    held = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    order = np.argsort(held.view(f"S{width}").ravel(), kind="stable")
    held, left = held[order], (ends - starts)[order]
    differ = np.ones((len(order) - 1, width + 1), bool)
    np.not_equal(held[1:], held[:-1], out=differ[:, :width])
    return order, np.concatenate(([0], np.minimum(differ.argmax(1), np.minimum(left[1:], left[:-1]))))


def maximal_repeats(before: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Length and suffixes of each interval of a common prefix of ``least`` or more that differs on the left.

    ``before``: the byte left of each suffix, or a number of its own where there is none.
    """
    long = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate(([0], long.astype(np.int8), [0]))))
    left = before[order].tolist()
    values = lcp.tolist()
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        stack: list[list] = []  # prefix length, first suffix, the one left byte or None if they differ
        for i in range(begin, end + 1):
            value = values[i] if i < end else 0
            first, seen = i - 1, left[i - 1]
            while stack and stack[-1][0] > value:
                length, first, other = stack.pop()
                seen = other if other == seen else None
                if seen is None:
                    yield length, order[first:i]
            if stack and stack[-1][0] == value:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else None
            elif value:
                stack.append([value, first, seen])


def first_documents(contexts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context and each place in it where a string starts: the least of ``docs`` whose context has it.

    One entry for a context in which all are the same. As a flat array, and where each context begins and ends in it.
    """
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - length + 1
    width = int(sizes.max())
    raw = np.frombuffer(b"".join([c.ljust(2 * width, b"\0") for c in contexts]), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), counts)
    place = np.concatenate(([0], np.cumsum(counts)))
    inside = np.arange(place[-1]) - place[owner]
    starts = owner * (2 * width) + inside
    before = np.where(inside > 0, raw[np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(starts)))
    best = docs[owner]
    order, lcp = suffix_order(raw, starts, owner * (2 * width) + sizes[owner], width)
    for common, found in maximal_repeats(before, order, lcp, length):
        least = docs[owner[found]].min()
        for part in range(0, len(found), 10_000):
            at = (found[part : part + 10_000, None] + np.arange(common - length + 1)).ravel()
            best[at] = np.minimum(best[at], least)
    equal = np.minimum.reduceat(best, place[:-1]) == np.maximum.reduceat(best, place[:-1])
    kept = ~equal[owner]
    kept[place[:-1]] = True
    return best[kept], np.concatenate(([0], np.cumsum(np.where(equal, 1, counts))))


def shared_anchors(docs: DataFrame, length: int) -> DataFrame:
    """``text_key`` and ``anchor`` for each anchor that several texts have. ``docs``: text, text_key.

    What many texts of one batch share is shared, whatever others have: those rows are spread by salts, and but one of
    them goes to meet the texts of other batches. So no task gets all rows of a frequent passage.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, LOOK):
            keys, at = np.unique(batch.column(1).to_numpy(), return_index=True)
            texts = batch.column(0).take(pa.array(at)).cast(pa.binary()).to_pylist()
            values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for a, b in chunks(texts):
                _, found, _, _, owner = anchors_of(texts[a:b], length)
                values.append(found)
                owners.append(a + owner)
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")  # texts of an anchor stay in order
            values, owners = values[order], owners[order]
            other = np.ones(len(values), bool)
            other[1:] = values[1:] != values[:-1]
            new = other.copy()
            new[1:] |= owners[1:] != owners[:-1]
            values, keys, first = values[new], keys[owners[new]], np.flatnonzero(other[new])
            counts = np.diff(first, append=len(values))
            salt = np.where(np.repeat(counts, counts) > HOT, 1 + keys % (SALTS - 1), 0).astype(np.uint64)
            met = first[counts > HOT]
            keys, values = np.concatenate((keys, keys[met])), np.concatenate((values | salt, values[met]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values.view(np.int64))], ["text_key", "salted"])

    rows = docs.select("text", "text_key").mapInArrow(emit, "text_key bigint, salted bigint")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of ``salted``, those of anchors with more than one text; a text may come more than once."""
        last: tuple[int, int, bool] | None = None  # the first row of what may go on in the next batch, and if it was told
        for batch in batches:
            if not batch.num_rows:
                continue
            text, salted = (batch.column(k).to_numpy() for k in ("text_key", "salted"))
            if last:
                text, salted = np.concatenate(([last[0]], text)), np.concatenate(([last[1]], salted))
            begin = np.flatnonzero(np.concatenate(([True], salted[1:] != salted[:-1])))
            size = np.diff(begin, append=len(text))
            other = text != np.repeat(text[begin], size)
            shared = np.logical_or.reduceat(other, begin) | (salted[begin] & int(_SALT) > 0)
            told = other.copy()
            told[begin] = True
            told &= np.repeat(shared, size)
            if last and last[2]:  # its first row was told before, and what is another text is now
                told[: size[0]] = other[: size[0]]
            ends = bool(shared[-1]) or bool(last and last[2] and len(begin) == 1)
            last = (int(text[begin[-1]]), int(salted[begin[-1]]), ends)
            yield pa.RecordBatch.from_arrays([pa.array(text[told]), pa.array(salted[told] & ~int(_SALT))], ["text_key", "anchor"])

    return rows.repartition("salted").sortWithinPartitions("salted").mapInArrow(several, "text_key bigint, anchor bigint")


def contexts_of(texts: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """One row per text of ``lists`` (doc_id, text_key, anchors): its contexts of those anchors, and the bytes they lie in.

    ``contexts``: anchor, ``key`` (a hash of the bytes), where it starts and how many strings it holds; ``at`` and
    ``parts``: the runs of bytes that contexts cover.
    """
    context = pa.struct([("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("places", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            # what a text of the batch asks for is shared, so whichever other text has it asks for it too
            wanted, texts = batch.column("anchors").flatten(), batch.column("text").cast(pa.binary()).to_pylist()
            values, counts, at, parts, many = [], [], [], [], []
            for a, b in chunks(texts):
                raw, h, first, last, owner = anchors_of(texts[a:b], length)
                h = h.view(np.int64)
                keep = np.flatnonzero(pc.is_in(pa.array(h), wanted).to_numpy(zero_copy_only=False))
                h, first, last, owner = h[keep], first[keep], last[keep], owner[keep]
                base = np.cumsum([0, *map(len, texts[a:b])])
                values.append((h, stretch_hashes(raw, first, last + length), (first - base[owner]).astype(np.int32), (last - first + 1).astype(np.int32)))
                counts.append(np.bincount(owner, minlength=b - a))
                new = np.ones(len(keep), bool)
                new[1:] = (first[1:] > last[:-1] + length) | (owner[1:] != owner[:-1])  # contexts are in order; where one doesn't touch the next
                edge = np.flatnonzero(new)
                begins, ends = first[edge], last[np.append(edge[1:], len(keep))[: len(edge)] - 1] + length
                at.append((begins - base[owner[edge]]).astype(np.int32))
                parts += [raw[x:y] for x, y in zip(begins.tolist(), ends.tolist())]
                many.append(np.bincount(owner[edge], minlength=b - a))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*values)], fields=list(context))
            bounds, edges = (pa.array(np.concatenate(([0], np.cumsum(np.concatenate(x)))), pa.int32()) for x in (counts, many))
            lists_ = [pa.ListArray.from_arrays(bounds, flat), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(at))), pa.ListArray.from_arrays(edges, pa.array(parts, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *lists_], ["doc_id", "text_key", "contexts", "at", "parts"])

    rows = texts.join(lists.hint("shuffle_hash"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "anchors")
    return rows.mapInArrow(emit, "doc_id bigint, text_key bigint, contexts array<struct<anchor:bigint,key:bigint,start:int,places:int>>, at array<int>, parts array<binary>")


def with_bytes(held: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """anchor, key, doc_id, n and the bytes of each of ``rows`` (doc_id, text_key, anchor, key, start, places, n), out of ``held`` (at, parts)."""
    names = ["anchor", "key", "start", "places", "n"]
    lists = rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*names)).alias("found"))  # of one text

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            found = batch.column("found")
            flat = found.flatten()
            sizes = np.diff(found.offsets.to_numpy())
            start = flat.field("start").to_numpy()
            size = flat.field("places").to_numpy() - 1 + length
            out, place = [], 0
            for at, parts, n in zip(batch.column("at"), batch.column("parts"), sizes.tolist()):
                at, parts, mine = at.values.to_numpy(), parts.as_py(), start[place : place + n]
                part = np.searchsorted(at, mine, "right") - 1
                begin = mine - at[part]
                out += [parts[p][a:b] for p, a, b in zip(part.tolist(), begin.tolist(), (begin + size[place : place + n]).tolist())]
                place += n
            docs = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("key"), docs, flat.field("n"), pa.array(out, pa.binary())], ["anchor", "key", "doc_id", "n", "context"])

    joined = held.select("doc_id", "text_key", "at", "parts").join(lists.hint("shuffle_hash"), ["doc_id", "text_key"]).select("doc_id", "at", "parts", "found")
    return joined.mapInArrow(emit, "anchor bigint, key bigint, doc_id bigint, n bigint, context binary")


def scan(contexts: DataFrame, length: int) -> DataFrame:
    """anchor, key and ``firsts`` of rows (anchor, key, doc_id, context): for each string of a context the least document among all of its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of anchor, as many whole anchors at once as make a suffix array of good size."""
        held: list[pa.RecordBatch] = []
        size = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            best, bounds = first_documents(table.column("context").to_pylist(), table.column("doc_id").to_numpy(), length)
            made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(best))
            return pa.RecordBatch.from_arrays([table.column("anchor").combine_chunks(), table.column("key").combine_chunks(), made], ["anchor", "key", "firsts"])

        for batch in sliced(batches, 2000):
            held.append(batch)
            size += batch.num_rows
            if size < 4000:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = np.flatnonzero(anchor[1:] != anchor[:-1])
            if len(cut):
                cut = int(cut[-1]) + 1
                yield done(table.slice(0, cut).combine_chunks())
                held, size = table.slice(cut).combine_chunks().to_batches(), len(anchor) - cut
        if size:
            yield done(pa.Table.from_batches(held).combine_chunks())

    laid = contexts.select("anchor", "key", "doc_id", "context").repartition("anchor").sortWithinPartitions("anchor", "key")
    return laid.mapInArrow(run, "anchor bigint, key bigint, firsts array<bigint>")


def parted(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The parts of contexts (anchor, key, doc_id, context) whose strings share a least run of ``gram`` bytes.

    anchor, key; ``offset`` and ``places``: where the part starts and its strings; part_anchor (of both anchors), part_key
    (of its bytes) and part. With ``gram`` as long as strings are, the parts are these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            texts = batch.column("context").to_pylist()
            raw = b"".join(texts)
            size = np.array([len(t) for t in texts])
            begin = np.concatenate(([0], np.cumsum(size)))[:-1]
            h, at = least_runs(raw, length, gram)
            owner = np.repeat(np.arange(len(texts)), size)[: len(at)]
            start = np.flatnonzero(np.arange(len(at)) + length <= (begin + size)[owner])  # strings inside one context
            at, owner = at[start], owner[start]
            first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
            places = np.diff(first, append=len(start))
            owner, low = owner[first], start[first]
            high = low + places - 1 + length
            both = h[at[first]] * _A ^ batch.column("anchor").to_numpy().view(np.uint64)[owner] * _B
            rows = pa.array(owner)
            columns = [batch.column("anchor").take(rows), batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array((low - begin[owner]).astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(both.view(np.int64)), pa.array(stretch_hashes(raw, low, high)), pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "doc_id", "offset", "places", "part_anchor", "part_key", "part"])

    return contexts.select("anchor", "key", "doc_id", "context").mapInArrow(run, "anchor bigint, key bigint, doc_id bigint, offset int, places int, part_anchor bigint, part_key bigint, part binary")


def least_documents(contexts: DataFrame, length: int, longer: Sequence[int] = LONGER) -> DataFrame:
    """anchor, key and ``firsts`` of different contexts (anchor, key, doc_id, n, context), n being how many their anchor has.

    Anchors with more than ``BLOCK`` are parted by the next longer one; of equal parts but one goes on, so a passage that
    very many contexts share counts once. The answers of the parts are put together for each context.
    """
    spark = contexts.sparkSession
    alone = contexts.filter(F.col("n") == 1).select("anchor", "key", F.array("doc_id").alias("firsts"))
    small = materialize(alone.unionByName(scan(contexts.filter((F.col("n") > 1) & (F.col("n") <= BLOCK)), length)))
    release(spark)
    hot = contexts.filter(F.col("n") > BLOCK)
    if not hot.limit(1).count():
        return small
    gram = longer[0] if longer else length
    parts = materialize(parted(hot, length, gram))
    one_each = materialize(parts.groupBy("part_anchor", "part_key", "part").agg(F.min("doc_id").alias("doc_id")))
    places = materialize(parts.drop("part", "doc_id"))
    discard(parts)
    release(spark)
    if longer:
        one_each_ = one_each.select(F.col("part_anchor").alias("anchor"), F.col("part_key").alias("key"), "doc_id", F.col("part").alias("context"))
        counted = materialize(one_each_.join(one_each_.groupBy("anchor").agg(F.count("*").alias("n")), "anchor"))
        discard(one_each)
        release(spark)
        known = least_documents(counted, length, longer[1:])
        discard(counted)
    else:
        known = materialize(one_each.select(F.col("part_anchor").alias("anchor"), F.col("part_key").alias("key"), F.array("doc_id").alias("firsts")))
        discard(one_each)
    met = places.join(known.withColumnsRenamed({"anchor": "part_anchor", "key": "part_key"}), ["part_anchor", "part_key"])
    whole = F.transform(F.sort_array(F.collect_list(F.struct("offset", "places", "firsts"))), lambda x: F.when(F.size(x["firsts"]) == 1, F.array_repeat(x["firsts"][0], x["places"])).otherwise(x["firsts"]))  # of one context
    made = met.groupBy("anchor", "key").agg(F.flatten(whole).alias("firsts"))
    made = made.select("anchor", "key", F.when(F.array_min("firsts") == F.array_max("firsts"), F.slice("firsts", 1, 1)).otherwise(F.col("firsts")).alias("firsts"))
    both = materialize(small.unionByName(made))
    discard(small, places, known)
    release(spark)
    return both


def settled(held: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """For each context (anchor, key): ``firsts``, the least document of the string at each of its places; one entry if all are the same."""
    spark = found.sparkSession
    distinct = materialize(found.groupBy("anchor", "key").agg(F.min(F.struct("doc_id", "text_key", "start", "places")).alias("f")).select("anchor", "key", "f.*"))
    counts = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("n")))
    counted = materialize(distinct.join(counts.hint("shuffle_hash"), "anchor"))
    discard(distinct, counts)
    release(spark)
    single = counted.filter("n = 1").select("anchor", "key", F.array("doc_id").alias("firsts"))
    several = materialize(with_bytes(held, counted.filter("n > 1"), length))
    release(spark)
    many = least_documents(several, length)
    discard(several)
    known = materialize(single.unionByName(many))
    discard(counted, many)
    return known


def covered_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """Rows (doc_id, text_key, spans): of each first document of a text, the runs of bytes to remove, in order.

    ``docs``: doc_id (bigint, not null), text (not null), ``same`` and ``text_key`` (hashes of the text).
    """
    spark = docs.sparkSession
    shared = materialize(shared_anchors(docs, length))
    release(spark)
    firsts = docs.groupBy("same", "text_key").agg(F.min("doc_id").alias("doc_id")).drop("same")
    lists = materialize(shared.groupBy("text_key").agg(F.collect_list("anchor").alias("anchors")).join(firsts, "text_key"))  # of one text
    discard(shared)
    release(spark)
    held = materialize(contexts_of(docs.select("doc_id", "text_key", "text"), lists, length))
    discard(lists)
    release(spark)
    found = held.select("doc_id", "text_key", F.explode("contexts").alias("c")).select("doc_id", "text_key", "c.*")
    known = settled(held, found, length)
    release(spark)
    rows = materialize(found.join(known.hint("shuffle_hash"), ["anchor", "key"]).filter(F.exists("firsts", lambda x: x < F.col("doc_id"))).select("doc_id", "text_key", "start", "places", "firsts"))
    discard(held, known)
    release(spark)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each context's strings to remove, as runs of places where they start."""
        for batch in sliced(batches, 5000):
            begins, ends, at = [], [], []
            for i, (doc, start, firsts_) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(), batch.column("firsts"))):
                gone = firsts_.values.to_numpy() < doc
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                begins += (start + edge[::2]).tolist()
                ends += (start + edge[1::2] - 1 + length).tolist()
                at += [i] * (len(edge) // 2)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "text_key", "begin", "end"])

    whole = rows.filter(F.size("firsts") == 1)  # all strings of the context go
    whole = whole.select("doc_id", "text_key", F.col("start").cast("long").alias("begin"), (F.col("start") + F.col("places") - 1 + length).cast("long").alias("end"))
    mixed = rows.filter(F.size("firsts") > 1).select("doc_id", "text_key", "start", "firsts")
    spread = whole.union(mixed.mapInArrow(spans, "doc_id bigint, text_key bigint, begin bigint, end bigint"))
    out = materialize(spread.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans")))
    discard(rows)
    return out


def merged(spans: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one: begins, ends and how many each text has.

    ``spans``: a list for each text (null: none) of begin and end, in order of begins; ``sizes``: how long texts are.
    """
    flat, many = spans.flatten(), pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
    owner = np.repeat(np.arange(len(many)), many)
    base = np.cumsum(sizes + 1) - sizes - 1  # texts lie one behind the other, and don't touch
    begin, end = (flat.field(k).to_numpy() + base[owner] for k in ("begin", "end"))
    end = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    owner = owner[first]
    return begin[first] - base[owner], end[np.append(first[1:], len(end))[: len(first)] - 1] - base[owner], np.bincount(owner, minlength=len(many))


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text: str = "text", carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """One row per row: doc_id, n_bytes, ``spans`` (begin and end of each maximal run removed) and ``kept`` (bytes).

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id; strings are
    those of the input, and don't cross documents; texts of any length are read whole. Null texts are empty, an empty
    table gives no rows; texts shorter than ``length`` stay whole.
    Of equal texts all but those with the least id go entirely. Rows with a null id stay whole and take nothing from
    others; rows that repeat an id take nothing from each other. Columns in ``carry`` come along, in ``carried``;
    others are left out. With ``as_text``, ``kept`` is a string, without characters that were cut in two.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried"))
    rows = rows.withColumn("same", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    known = rows.filter(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    spans = covered_spans(known.select("doc_id", "text", "same", "text_key"), length)
    member = materialize(known.select("doc_id", "same", "text_key", F.octet_length("text").cast("long").alias("n")))
    reps = materialize(member.groupBy("same").agg(F.min("doc_id").alias("rep")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))
    copies = member.join(reps, "same").filter((F.col("doc_id") > F.col("rep")) & (F.col("n") >= length))
    copies = copies.select("doc_id", "text_key", whole.alias("spans"))
    marks = materialize(spans.union(copies).dropDuplicates(["doc_id", "text_key"]))
    discard(spans, member, reps)
    release(rows.sparkSession)
    marks = marks.withColumnRenamed("doc_id", "__doc").withColumnRenamed("text_key", "__key")
    marked = rows.join(marks.hint("shuffle_hash"), (F.col("doc_id").cast("bigint") == F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            begins, ends, many = merged(batch.column(2), sizes)
            gone = pa.StructArray.from_arrays([pa.array(begins), pa.array(ends)], ["begin", "end"])
            gone = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), gone)
            begins, ends, kept, at = begins.tolist(), ends.tolist(), [], 0
            for raw, n in zip(texts, many.tolist()):
                rest = b"".join([raw[a:b] for a, b in zip([0, *ends[at : at + n]], [*begins[at : at + n], len(raw)])]) if n else raw
                at += n
                kept.append(kept_text(rest) if as_text else rest)
            made = [pa.array(sizes), gone, pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *([batch.column(3)] if carry else [])], ["doc_id", "n_bytes", "spans", "kept", *["carried"] * bool(carry)])

    schema = f"doc_id {kind}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}"
    if carry:
        schema += f", carried {rows.schema['carried'].dataType.simpleString()}"
    return marked.select("doc_id", "text", "spans", *["carried"] * bool(carry)).mapInArrow(cut, schema)


def kept_text(kept: bytes) -> str:
    """The bytes that stay as text, without characters that were cut in two."""
    return kept.decode("utf-8", "ignore")
