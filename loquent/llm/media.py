"""Media columns: interleaved sequences of text and media, with payloads kept in a table of their own by digest.

A page becomes an ordered array of items, each text or a reference to a medium with its caption. References name
the SHA-256 of the stored medium; a join on that digest gives each reference what the media table holds of it, and
positions and captions stay with their items. Payloads are never shuffled: what a query needs of a medium is read
where the medium lies, reduced to one row per digest, and joined to the references.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loquent.llm.common import sliced, text_or_empty

#: Samples per row of a stored image, and per tile that payloads are padded to.
WIDTH, TILE = 24, 576
ITEM = "struct<position:int,kind:string,text:string,ref:string,digest:string>"
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript", "title"))
_DIGEST = re.compile(r"sha256:([0-9a-fA-F]{64})$")


class SequenceParser(HTMLParser):
    """Collects items in document order; a figcaption becomes the caption of its figure's first medium."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add("text", text, None)

    def add(self, kind: str, text: str | None, ref: str | None) -> None:
        found = _DIGEST.match(ref or "")
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "ref": ref, "digest": found[1].lower() if found else None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA:
            given = dict(attrs)
            self.flush()
            if given.get("src"):
                self.add(_MEDIA[tag], given.get("alt") or given.get("title"), given["src"])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append(len(self.items))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            media = [x for x in self.items[self.figures[-1] if self.figures else 0 :] if x["ref"] is not None]
            if media and text:
                media[0]["text"] = text
            elif text:
                self.add("text", text, None)
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    parser = SequenceParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: its id and ``items``, in document order. Null and empty pages have no items."""
    source = pages.select(F.col(id_col), text_or_empty(html).alias("html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("digest", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            items = [parse_sequence(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, kind)], [id_col, "items"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, items array<{ITEM}>")


def resolve(seqs: DataFrame, media: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per item with the columns of ``media``, which has each ``digest`` once; null where none matches.

    Items without a digest bypass the join, and Spark may split the partitions of a digest that very many share.
    Pages that repeat an id, or have none, keep their items as rows of their own.
    """
    items = seqs.select(F.col(id_col), F.explode("items").alias("item")).select(id_col, "item.*")
    held = media.withColumnRenamed("digest", "__digest").filter(F.col("__digest").isNotNull())
    named = items.filter(F.col("digest").isNotNull()).join(held, F.col("digest") == F.col("__digest"), "left").drop("__digest")
    return named.unionByName(items.filter(F.col("digest").isNull()), allowMissingColumns=True)


def assemble(resolved: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The sequences again, each item with what it resolved to; positions and captions as parsed."""
    fields = ["position", *[c for c in resolved.columns if c not in (id_col, "position")]]
    return resolved.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))


def padded(data: Column) -> Column:
    """``data`` with bytes 255 appended up to a positive multiple of ``TILE``."""
    tiles = F.greatest(F.ceil(F.octet_length(data) / TILE), F.lit(1))
    return F.rpad(data, (tiles * TILE).cast("int"), F.lit(b"\xff"))


def store(payload: Column) -> Column:
    """A grey image in the PGM format, 8 bits a sample, of ``WIDTH`` samples a row, that holds the payload."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "UTF-8"), payload)


def stored_payload(medium: bytes) -> bytes:
    """The samples of a stored image; ValueError if it isn't one."""
    head = re.match(rb"P5\n(\d+) (\d+)\n255\n", medium)
    if not head or len(medium) != head.end() + int(head[1]) * int(head[2]):
        raise ValueError("not a whole PGM image of 8 bits a sample")
    return medium[head.end() :]


def average_hash(payload: bytes) -> str:
    """16 hex digits: of 64 equal runs of samples, which have a mean above that of all."""
    means = np.array([x.mean() for x in np.array_split(np.frombuffer(payload, np.uint8), 64)])
    return np.packbits(means > means.mean()).tobytes().hex()


def media_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` of its text, ``medium`` (the stored image) and its ``digest``.

    A null text counts as empty, texts of any length are stored whole. Equal texts have equal media and digests; rows
    that repeat an id, and null ids, stay as they are; other columns are left out. No rows give none.
    """
    rows = docs.select(F.col(id_col), F.encode(text_or_empty(text), "UTF-8").alias("__data"))
    rows = rows.select(id_col, F.octet_length("__data").cast("long").alias("n_bytes"), store(padded(F.col("__data"))).alias("medium"))
    return rows.withColumn("digest", F.sha2("medium", 256))


def read_back(media: DataFrame) -> DataFrame:
    """One row per digest: sizes, hashes and feature of the medium and of the payload read back from it.

    Media that repeat are one row; a medium that isn't a whole image is an error, as it would be lost otherwise.
    """
    schema = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for digest, medium in zip(batch.column(0).to_pylist(), batch.column(1)):
                medium = medium.as_py()
                payload = stored_payload(medium)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(medium), hashlib.sha256(medium).hexdigest(), average_hash(payload)))
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    read = media.select("digest", "medium").mapInArrow(run, schema)
    return read.groupBy("digest").agg(*[F.first(n).alias(n) for n in names[1:]])


def document_pages(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A page for each document: a lead, a figure that names the stored medium by digest, and its caption."""
    html = F.format_string('<article><p>Document</p><figure><img src="sha256:%s"><figcaption>%d bytes</figcaption></figure></article>', "digest", "n_bytes")
    return media.select(id_col, html.alias("html"))
