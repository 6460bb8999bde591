"""Best-fit packing of tokenised documents into sequences, by the linear grouping scheme.

Lengths are whole numbers up to the sequence length, so the histogram of lengths is of bounded size whatever the
corpus. On it the driver plans: large lengths are rounded up within groups of equal cardinality, configurations of
the few sizes left are chosen, actual lengths are put back, and small pieces go where they fit best. The plan says
which ranks among the pieces of one length go where; pieces are ranked and placed by Spark.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loquent.llm.common import materialize, text_or_empty

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\\t-\\r \x85\xa0"
#: The vocabulary's own split of a text, for texts within Latin-1.
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Encoder(dict):
    """Ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    Pieces of text that the vocabulary never merges across are encoded once and kept, up to a number, then anew.
    """

    def __init__(self, path: str, keep: int = 700_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.keep = self.tokenizer.model, keep
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = {b: chr(b) if b in kept else chr(next(rest)) for b in range(256)}

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= 32:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if (text.isascii() or all(c < "Ā" for c in set(text))) and not self.special.search(text):
            return b"".join(map(self.__getitem__, LATIN.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids (``with_ids``: and ``ids``).

    A document is its ids and ``end_id``; one longer than ``size`` is cut so that only its first piece is shorter.
    Null and empty texts are one piece of one id. Rows are kept as they are, null and repeated ids too.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            at, rows, ids, held = [], [], [], 0
            for i, value in enumerate(batch.column(1)):
                raw = encode(value.as_py()) + last
                n = len(raw) // 4
                begin, end = 0, n % size or min(n, size)
                for piece in range(-(-n // size)):
                    part = raw[4 * begin : 4 * end]
                    at.append(i)
                    rows.append((piece, begin, end - begin, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4"))
                        held += end - begin
                    begin, end = end, end + size
                if at and (held >= 4_000_000 or i + 1 == batch.num_rows):
                    columns = [batch.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]]
                    if with_ids:
                        columns.append(pa.array(ids, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                    at, rows, ids, held = [], [], [], 0

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


class Run:
    """So many sequences that hold the same lengths: pairs of a length and how often."""

    __slots__ = ("n", "items", "free")

    def __init__(self, n: int, items: tuple[tuple[int, int], ...], free: int):
        self.n, self.items, self.free = n, items, free


def grouped(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with counts, longest first, in groups of equal cardinality; those of one size make one group."""
    total = sum(c for _, c in large)
    out: list[list[tuple[int, int]]] = []
    done = 0
    for length, count in large:
        while count:
            group = done * groups // total
            room = min(count, -(-(group + 1) * total // groups) - done)
            if out and (group == out_group or out[-1][0][0] == length):
                out[-1].append((length, room))
            else:
                out.append([(length, room)])
            out_group = group
            done, count = done + room, count - room
    return out


def fullest(sizes: list[int], left: list[int], room: int) -> dict[int, int]:
    """Which sizes, and how often, fill ``room`` most; no more of a size than there are."""
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1)
    for k, size in enumerate(sizes):
        for _ in range(min(left[k], room // size)):
            new = np.zeros_like(reached)
            new[size:] = reached[:-size] & ((by[:-size] <= k))
            new &= ~reached
            if not new.any():
                break
            by[new] = k
            reached |= new
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    used: dict[int, int] = defaultdict(int)
    while at:
        k = int(by[at])
        used[k] += 1
        at -= sizes[k]
    return used


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often which configuration: the largest size left with what fills its sequence most, as often as it lasts."""
    left, out = list(counts), []
    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        left[first] -= 1
        rest = fullest(sizes[first:], left[first:], capacity - sizes[first])
        left[first] += 1
        used: dict[int, int] = defaultdict(int)
        used[first] += 1
        for k, m in rest.items():
            used[first + k] += m
        # a size taken several times may be short of that: by the walk back at most its count was used
        times = max(1, min(left[k] // m for k, m in used.items()))
        for k, m in used.items():
            left[k] -= times * m
        out.append((times, dict(used)))
    return out


def substituted(times: int, used: dict[int, int], groups: list[list[list[int]]], capacity: int) -> Iterator[Run]:
    """The sequences of a configuration, with actual lengths in place of the sizes they were rounded up to."""
    while times:
        slots, n = [], times
        for k, m in used.items():
            queue = groups[k]
            whole = queue[-1][1] // m
            if whole:  # all m from one length, in as many sequences as that lasts
                slots.append((k, [(queue[-1][0], m)]))
                n = min(n, whole)
            else:  # the last few of a length, with the next ones
                need, mixed, at = m, [], len(queue) - 1
                while need:
                    take = min(need, queue[at][1])
                    mixed.append((queue[at][0], take))
                    need, at = need - take, at - 1
                slots.append((k, mixed))
                n = 1
        items: dict[int, int] = defaultdict(int)
        for k, parts in slots:
            for length, m in parts:
                items[length] += m
                queue, left = groups[k], n * m
                while left:
                    take = min(left, queue[-1][1])
                    queue[-1][1] -= take
                    left -= take
                    if not queue[-1][1]:
                        queue.pop()
        held = tuple(items.items())
        yield Run(n, held, capacity - sum(a * b for a, b in held))
        times -= n


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = 500, small: int = 256) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, a sequence's share, offset) that place all pieces.

    Of the pieces of ``length``, those from the first rank on go to consecutive sequences, so many in each, from
    the offset on. The number of rows depends on lengths and groups, not on how many pieces there are.
    """
    runs: list[Run] = []
    lengths = sorted((x for x in histogram.items() if x[1]), reverse=True)
    if lengths and lengths[0][0] == capacity:
        runs.append(Run(lengths[0][1], ((capacity, 1),), 0))
    large = [x for x in lengths if small < x[0] < capacity]
    made = grouped(large, groups)
    queues = [[list(x) for x in reversed(g)] for g in made]
    for times, used in configurations([g[0][0] for g in made], [sum(c for _, c in g) for g in made], capacity):
        runs += substituted(times, used, queues, capacity)
    by_free: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_free[run.free].append(run)
    for length, count in lengths:
        if length > small or length == capacity:
            continue
        free = sorted(f for f, r in by_free.items() if r and f >= length)
        while count:
            at = bisect_left(free, length)
            if at == len(free):  # none fits: open new sequences
                each = min(count, capacity // length)
                opened = Run(count // each, ((length, each),), capacity - each * length)
                by_free[opened.free].append(opened)
                count -= opened.n * each
                if opened.free >= length and opened.free not in free:
                    free = sorted([*free, opened.free])
                continue
            gap = free[at]
            each = min(count, gap // length)
            run = by_free[gap].pop()
            n = min(run.n, count // each)
            if n < run.n:
                by_free[gap].append(Run(run.n - n, run.items, gap))
            elif not by_free[gap]:
                free.pop(at)
            left = gap - each * length
            by_free[left].append(Run(n, (*run.items, (length, each)), left))
            if left >= length and left not in free:
                free = sorted([*free, left])
            count -= n * each
    rows, ranks, sequence = [], defaultdict(int), 0
    for run in (r for f in sorted(by_free) for r in by_free[f]):
        offset = 0
        for length, each in run.items:
            rows.append((length, ranks[length], run.n * each, sequence, each, offset))
            ranks[length] += run.n * each
            offset += length * each
        sequence += run.n
    return sorted(rows)


def ranked(cut: DataFrame, counts: dict[int, int], per_group: int = 20_000) -> DataFrame:
    """Adds ``rank``, from 0 among the pieces of one length, without a task that sees all pieces of a length."""
    shares = F.array(*[F.lit(max(1, -(-counts.get(x, 0) // per_group))) for x in range(max(counts, default=0) + 1)])
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(shares, F.col("length").cast("int")))
    cut = cut.withColumn("__group", dealt.cast("int"))
    held = cut.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    held = materialize(held.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    within = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "ids_crc32", "start")
    out = cut.withColumn("__at", F.row_number().over(within) - 1).join(held, ["length", "__group"])
    return out.withColumn("rank", F.col("__at") + F.col("__before")).drop("__at", "__before", "__group")


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 2, groups: int = 500, small: int = 256, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``: gapless from 0 in each sequence.

    Every piece is placed. No rows give none. Nulls and repeated rows: as ``pieces`` says; other columns go. Texts of any
    length are encoded whole, and cut into pieces of ``size`` at most.
    """
    cut = materialize(pieces(docs, path, size, end_id, id_col, text))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    placed = np.array(plan(counts, size, groups, small) or np.zeros((0, 6)), np.int64)
    # ranks of one length are consecutive from 0: a key of both finds the row of the plan
    stride = max(counts.values(), default=0) + 1
    keys = placed[:, 0] * stride + placed[:, 1]
    kinds = dict(cut.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = placed[np.searchsorted(keys, length * stride + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = f"doc_id {kinds['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked(cut, counts).mapInArrow(place, schema)
