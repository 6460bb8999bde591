"""Token counts of every prefix of a text, by dynamic programming over prefixes.

A sequence of tokens is what byte-pair merging gives if and only if each token and each two neighbours are. So the
last token of a prefix is the one token that fits the last token of the prefix before it, and the count of a
prefix is that shorter prefix's count plus one. One pass stores the count at every prefix of the text; questions
about truncation and budgets are then look-ups.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loquent.llm.common import text_or_empty

END = "</w>"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\\t-\\r \x85\xa0"
#: For texts within Latin-1: tiles the text with pieces, each with the one white-space character before it.
LATIN = re.compile(rf"[{_SPACE}]?(?:'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+)|[{_SPACE}]+")
LATIN_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Pieces(dict):
    """What the characters of a piece add to the count; short pieces are kept, up to a number, then anew."""

    def __init__(self, counter: PrefixCounter, keep: int):
        super().__init__()
        self.counter, self.keep = counter, keep

    def __missing__(self, piece: str) -> bytes:
        found = self.counter.piece_steps(piece)
        if len(piece) <= 32:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = found
        return found


class PrefixCounter:
    """Counts of a word-end BPE vocabulary file at every prefix of a text."""

    def __init__(self, path: str, keep: int = 700_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {tuple(p): r for r, p in enumerate(pairs)}
        #: By the two tokens: when they merge. By the token: when its merge happens, and of which two; -1 for single letters.
        self.joins: dict[int, int] = {}
        self.made = [-1] * (max(self.names) + 1)
        self.halves = [(-1, -1)] * len(self.made)
        for rank, (one, two) in enumerate(pairs):
            a, b, t = self.vocab[one], self.vocab[two], self.vocab[one + two]
            self.joins.setdefault(a << 20 | b, rank)
            if self.made[t] < 0:
                self.made[t], self.halves[t] = rank, (a, b)
        #: For each beginning of a token: the token that it is inside a piece and at the end of one, or -1.
        self.parts: dict[str, tuple[int, int]] = {}
        for token in self.vocab:
            bare = token.removesuffix(END) or token
            for i in range(1, len(bare) + 1):
                part = bare[:i]
                if part not in self.parts:
                    self.parts[part] = (self.vocab.get(part, -1), self.vocab.get(part + END, -1))
        self.special = re.compile("|".join(sorted((re.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)))
        self.letters = byte_letters()
        self.pieces = Pieces(self, keep)
        self.fits: dict[int, bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def follows(self, before: int, token: int) -> bool:
        """Whether merging keeps both tokens as they are; before: -1 at the start of a piece."""
        if before < 0:
            kept = self.fits[-1 - token] = self.merged(self.symbols(self.names[token])) == [self.names[token]]
            return kept
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        left, right, until = before, token, 1 << 60
        while True:  # undo merges at the seam from the last on: none across it may come before the one undone
            if self.joins.get(left << 20 | right, until) < until:
                kept = False
                break
            a, b = self.made[left], self.made[right]
            if a < 0 and b < 0:
                kept = True
                break
            if a > b:
                left, until = self.halves[left][1], a
            else:  # of equal merges the left one is first, so one across the seam is before that on the right
                right, until = self.halves[right][0], b + 1
        self.fits[before << 20 | token] = kept
        return kept

    def counts(self, piece: str) -> list[int]:
        """The counts of the prefixes of one piece, given in byte letters."""
        parts, fits, follows = self.parts, self.fits, self.follows
        n = len(piece)
        last, inner, whole = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for j in range(n):  # the shorter prefix ends at j, and its last token is known by now
            before, one_more = last[j], inner[j] + 1
            base = before << 20 if before >= 0 else -1
            for i in range(j + 1, n + 1):
                found = parts.get(piece[j:i])
                if found is None:
                    break
                token, ending = found
                if token >= 0 and last[i] < 0:
                    known = fits.get(base | token if before >= 0 else base - token)
                    if follows(before, token) if known is None else known:
                        last[i], inner[i] = token, one_more
                if ending >= 0 and not whole[i]:
                    known = fits.get(base | ending if before >= 0 else base - ending)
                    if follows(before, ending) if known is None else known:
                        whole[i] = one_more
        return whole[1:]

    def piece_steps(self, piece: str) -> bytes:
        """Of a piece of Latin-1 text, what each character adds to the count, as 16-bit numbers."""
        lead = 0
        while lead < len(piece) and piece[lead] in LATIN_SPACE:
            lead += 1
        raw = piece[lead:].encode()
        counts = self.counts("".join(map(self.letters.__getitem__, raw)))
        at_chars = [c for i, c in enumerate(counts) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
        return array("h", [0] * lead + [b - a for a, b in zip([0, *at_chars], at_chars)]).tobytes()

    def plain(self, text: str) -> np.ndarray:
        """Counts at every prefix of a text without special strings."""
        if text.isascii() or all(c < "Ā" for c in set(text)):
            steps = b"".join(map(self.pieces.__getitem__, LATIN.findall(text.lower())))
            return np.frombuffer(steps, np.int16).cumsum(dtype=np.int32)
        text = self.tokenizer.normalizer.normalize_str(text)
        steps = np.zeros(len(text), np.int32)
        for piece, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            ends = np.cumsum([len(c.encode()) for c in text[begin:end]])
            counts = np.array([0, *self.counts(piece)])[np.concatenate(([0], ends))]
            steps[begin:end] = np.diff(counts)
        return steps.cumsum(dtype=np.int32)

    def __call__(self, text: str) -> np.ndarray:
        """Counts at every prefix; where a special string of the vocabulary ends, it counts as one token."""
        out, base, at = [], 0, 0
        for m in self.special.finditer(text) if "<|" in text else ():
            head = m.start() - at
            counts = self.plain(text[at : m.end() - 1])
            tail = len(m[0]) - 1
            head_count = int(counts[len(counts) - tail - 1]) if head else 0
            out += [counts + base, np.array([base + head_count + 1], np.int32)]
            base, at = base + head_count + 1, m.end()
        out.append(self.plain(text[at:]) + np.int32(base))
        return np.concatenate(out) if len(out) > 1 else out[0]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text", flush: int = 4_000_000) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_bytes`` and ``counts``, the token count of every prefix.

    ``counts[i]`` is the count of the first i + 1 characters of the text (for texts beyond Latin-1: of the text as
    the vocabulary normalises it, whose length may differ). It is exact, may fall as a prefix grows, and its last
    entry is the count of the whole text. Null and empty texts have an empty array and 0 bytes; null ids and rows
    that repeat are kept as they are; other columns are left out. Texts are whole whatever their length: results
    leave a task as soon as they hold ``flush`` characters.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)

        def made(ids: pa.Array, n_bytes: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(c) for c in counts]))).astype(np.int32)
            values = pa.array(np.concatenate(counts), pa.int32())
            return pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "n_bytes", "counts"])

        for batch in batches:
            ids, n_bytes, counts, first, held = batch.column(0), [], [], 0, 0
            for i, value in enumerate(batch.column(1)):
                one = value.as_py()
                n_bytes.append(len(one.encode()))
                counts.append(count(one))
                held += len(counts[-1])
                if held >= flush or i + 1 == batch.num_rows:
                    yield made(ids.slice(first, i + 1 - first), n_bytes, counts)
                    n_bytes, counts, first, held = [], [], i + 1, 0

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, counts array<int>")


def total(counts: str = "counts") -> Column:
    """The count of the whole text."""
    return F.coalesce(F.get(counts, F.size(counts) - 1), F.lit(0)).cast("long")


def tokens_at(length: int | Column, counts: str = "counts") -> Column:
    """The count of the first ``length`` characters; that of the whole text where it is shorter."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.coalesce(F.get(counts, F.least(length, F.size(counts)) - 1), F.lit(0)).cast("long")


def longest_within(budget: int, counts: str = "counts") -> Column:
    """The length in characters of the longest prefix of at most ``budget`` tokens."""
    fitting = F.transform(F.col(counts), lambda c, i: F.when(c <= budget, i + 1))
    return F.coalesce(F.array_max(fitting), F.lit(0)).cast("long")
