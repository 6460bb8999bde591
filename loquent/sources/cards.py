"""Character cards: JSON of several versions, alone or inside a PNG image."""

from __future__ import annotations

import base64
import binascii
import json
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from loquent.functions.text import null_if_blank, slugify

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Keywords of text chunks that hold a card, the preferred one first.
KEYWORDS = (b"ccv3", b"chara")
TEXTS = ("name", "description", "personality", "scenario", "first_mes", "mes_example", "system_prompt", "post_history_instructions", "creator_notes")
LISTS = ("tags", "alternate_greetings")
CARD = StructType([*[StructField(n, StringType()) for n in TEXTS], *[StructField(n, ArrayType(StringType())) for n in LISTS], StructField("lore", IntegerType())])


def chunks(image: bytes) -> list[tuple[bytes, bytes]]:
    """Kinds and contents of a PNG's chunks, as far as they are whole."""
    if not image.startswith(SIGNATURE):
        return []
    found, at = [], len(SIGNATURE)
    while at + 12 <= len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        if at + 12 + size > len(image):
            break
        found.append((kind, image[at + 8 : at + 8 + size]))
        at += 12 + size
    return found


def card_json(image: bytes) -> str | None:
    """The JSON text of the card in a PNG, or None."""
    texts = dict(reversed([body.split(b"\0", 1) for kind, body in chunks(image) if kind == b"tEXt" and b"\0" in body]))
    for keyword in KEYWORDS:
        try:
            return base64.b64decode(texts[keyword], validate=False).decode()
        except (KeyError, binascii.Error, UnicodeDecodeError):
            continue
    return None


def with_card(image: bytes, card: str) -> bytes:
    """The image with ``card`` as its only card chunk, before its end."""
    body = b"ccv3\0" + base64.b64encode(card.encode())
    kept = [(k, b) for k, b in chunks(image) if not (k == b"tEXt" and b.split(b"\0", 1)[0] in KEYWORDS)]
    at = next((i for i, (k, _) in enumerate(kept) if k == b"IEND"), len(kept))
    kept.insert(at, (b"tEXt", body))
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in kept)


def blank_image() -> bytes:
    """A black image of one sample."""
    parts = [(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


@F.pandas_udf(BinaryType())
def card_image(cards: pd.Series) -> pd.Series:
    """A blank image with the card in it."""
    return cards.map(lambda x: with_card(blank_image(), x) if x is not None else None)


@F.pandas_udf(StringType())
def png_card(images: pd.Series) -> pd.Series:
    return images.map(lambda x: card_json(bytes(x)) if x is not None else None)


def _strings(items: object) -> list[str]:
    return [x for x in items if isinstance(x, str) and x.strip()] if isinstance(items, list) else []


def fields(text: str | None) -> dict | None:
    """A card's fields whatever its version; None if the text is no card."""
    try:
        card = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(card, dict):
        return None
    if isinstance(card.get("data"), dict):
        data = card["data"]
    elif "char_name" in card:  # a flat form with names of its own
        names = {"name": "char_name", "description": "char_persona", "first_mes": "char_greeting", "mes_example": "example_dialogue", "scenario": "world_scenario"}
        data = {k: card.get(v) for k, v in names.items()}
    elif "name" in card:
        data = card
    else:
        return None
    out: dict = {k: data[k] if isinstance(data.get(k), str) and data[k].strip() else None for k in TEXTS}
    book = data.get("character_book")
    entries = book.get("entries") if isinstance(book, dict) else None
    return out | {k: _strings(data.get(k)) for k in LISTS} | {"lore": len(entries) if isinstance(entries, (list, dict)) else 0}


@F.pandas_udf(CARD)
def card_fields(texts: pd.Series) -> pd.DataFrame:
    rows = [fields(t) or dict.fromkeys(CARD.names) for t in texts]
    return pd.DataFrame(rows, columns=CARD.names)


def read_pngs(spark: SparkSession, path: str) -> DataFrame:
    """file, handle and fields of each card image under ``path``; images without a card are left out."""
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return parsed(images.select(F.col("path").alias("file"), png_card("content").alias("json")))


def read_jsons(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return parsed(texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")))


def parsed(texts: DataFrame) -> DataFrame:
    rows = texts.select("file", card_fields("json").alias("card")).select("file", "card.*").filter(F.col("name").isNotNull())
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[A-Za-z]+$", "")
    return rows.withColumn("handle", slugify(F.url_decode(stem)))


def card_v3(card: DataFrame) -> Column:
    """The JSON of a card of version 3 from its fields."""
    names = [c for c in card.columns if c not in ("file", "handle", "lore")]
    return F.to_json(F.struct(F.lit("chara_card_v3").alias("spec"), F.lit("3.0").alias("spec_version"), F.struct(*names).alias("data")))


def embed_text(greetings: str = "alternate_greetings") -> Column:
    """The fields of a card that are there, with labels, a line each, for an encoder; at most 32768 characters."""
    labelled = [("Name", "name"), ("Description", "description"), ("Personality", "personality"), ("Scenario", "scenario"), ("First message", "first_mes"), ("Examples", "mes_example"), ("Notes", "creator_notes")]
    lines = [F.concat(F.lit(f"{label}: "), null_if_blank(F.col(c))) for label, c in labelled]
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    hello = F.when(F.size(greetings) > 0, F.concat(F.lit("Greetings: "), F.array_join(greetings, "\n---\n")))
    return F.substring(F.concat_ws("\n", *lines, tags, hello), 1, 32_768)


def next_versions(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Cards to add as new versions: those whose hash isn't stored, numbered after the handle's last. Columns handle, import_hash."""
    fresh = found.dropDuplicates(["handle", "import_hash"]).join(stored.select("handle", "import_hash"), ["handle", "import_hash"], "left_anti")
    last = stored.groupBy("handle").agg(F.max("version").alias("__v"))
    nth = F.row_number().over(Window.partitionBy("handle").orderBy("import_hash"))
    return fresh.join(last, "handle", "left").withColumn("version", F.coalesce("__v", F.lit(0)) + nth).drop("__v")
