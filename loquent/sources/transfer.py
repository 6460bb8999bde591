"""Whole characters in and out: cards with their lorebooks into versions and entries, and these into cards again.

Joins of characters are merged: files of cards compress so well that Spark would take them for small and broadcast them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loquent.functions.text import slugify
from loquent.sources.cards import LISTS, TEXTS, card_v3
from loquent.sources.scratch import written

_ENTRIES = "character_book.entries"


def _typed(value: Column, path: str, kind: str, as_type: str) -> Column:
    """What lies at a path of a variant, if it is of that JSON type."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == kind, F.try_variant_get(value, path, as_type))


def lore_entries(cards: DataFrame) -> DataFrame:
    """The lorebook entries of cards (file, json): file, pos, title, keys, content, enabled, priority.

    Entries are a list, or an object, of which numbered names come first in their order and then the others by name.
    What is no object is left out; a card without a book has none, nor has a text that is no JSON.
    """
    v = F.try_parse_json("json")
    lists = [F.try_variant_get(v, f"$.{at}", "array<variant>") for at in (f"data.{_ENTRIES}", _ENTRIES)]
    maps = [F.try_variant_get(v, f"$.{at}", "map<string,variant>") for at in (f"data.{_ENTRIES}", _ENTRIES)]
    number = lambda key: F.coalesce(key.try_cast("long"), F.lit(2**62))
    of_map = lambda m: F.transform(F.array_sort(F.transform(F.map_keys(m), lambda k: F.struct(number(k).alias("n"), k.alias("k")))), lambda x: F.element_at(m, x["k"]))
    items = F.coalesce(*lists, *[F.when(m.isNotNull(), of_map(m)) for m in maps])
    objects = F.filter(items, lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    rows = cards.select("file", F.posexplode(objects).alias("pos", "e"))
    e = F.col("e")
    text = lambda name: _typed(e, f"$.{name}", "STRING", "string")
    keys = F.transform(F.filter(F.coalesce(F.try_variant_get(e, "$.keys", "array<variant>"), F.array().cast("array<variant>")), lambda k: F.schema_of_variant(k) == "STRING"), lambda k: F.variant_get(k, "$", "string"))
    first = F.get(keys, F.lit(0))
    title = F.coalesce(*[F.nullif(c, F.lit("")) for c in (text("comment"), text("name"), first)], F.lit("Untitled"))
    enabled = F.coalesce(_typed(e, "$.enabled", "BOOLEAN", "boolean"), F.lit(True))
    return rows.select("file", "pos", title.alias("title"), keys.alias("keys"), F.coalesce(text("content"), F.lit("")).alias("content"), enabled.alias("enabled"), F.coalesce(F.try_variant_get(e, "$.insertion_order", "double"), F.lit(0.0)).alias("priority"))


@dataclass(frozen=True)
class Import:
    """New versions, their lorebook entries, and for each card found whether it made a character, a version or nothing."""

    versions: DataFrame
    lore: DataFrame
    report: DataFrame


def import_cards(found: DataFrame, stored: DataFrame) -> Import:
    """Cards (owner_id, handle, file, json, import_hash and fields) as new versions of an owner's characters.

    stored: owner_id, handle, version, import_hash. A card whose hash is that of the character's last version changes
    nothing; of several cards of one handle the file of least name counts, and the others are told as repeated.
    """
    who = ["owner_id", "handle"]
    nth = F.row_number().over(Window.partitionBy(*who).orderBy("file", "import_hash"))
    numbered = written(found.withColumn("__nth", nth))
    last = stored.groupBy(*who).agg(F.max("version").alias("__v"), F.max_by("import_hash", "version").alias("__hash"))
    both = numbered.join(last.hint("merge"), who, "left")
    state = F.when(F.col("__nth") > 1, "repeated").when(F.col("__v").isNull(), "created").when(F.col("__hash").eqNullSafe(F.col("import_hash")), "unchanged").otherwise("new version")
    told = written(both.withColumn("state", state).withColumn("version", F.coalesce("__v", F.lit(0)) + (state.isin("created", "new version")).cast("int")))
    new = told.filter(F.col("state").isin("created", "new version"))
    lore = lore_entries(new.select(F.struct(*who, "version").alias("file"), "json")).select("file.*", "pos", "title", "keys", "content", "enabled", "priority")
    kept = [c for c in found.columns if c != "json"]
    return Import(new.select(*kept, "version"), lore, told.select(*who, "file", "state", "version"))


def unread(files: DataFrame, found: DataFrame) -> DataFrame:
    """The files of an import that no card came out of: file and state."""
    return files.select("file").distinct().join(found.select("file").distinct(), "file", "left_anti").withColumn("state", F.lit("unreadable"))


def export_cards(versions: DataFrame, lore: DataFrame) -> DataFrame:
    """owner_id, handle, file and json: the last version of each character as a card with its lorebook.

    versions: owner_id, handle, version and the fields of a card; lore: owner_id, handle, version, pos, keys, content,
    enabled, priority. A file is named after its character; the handle tells those of one name apart.
    """
    who = ["owner_id", "handle", "version"]
    last = versions.join(versions.groupBy("owner_id", "handle").agg(F.max("version").alias("version")).hint("merge"), who, "left_semi")
    entry = F.struct("pos", "keys", "content", "enabled", F.col("priority").alias("insertion_order"))
    books = lore.join(last.select(who).hint("merge"), who, "left_semi").groupBy(*who).agg(F.sort_array(F.collect_list(entry)).alias("__e"))  # of one character
    books = books.select(*who, F.struct(F.transform("__e", lambda x: x.dropFields("pos")).alias("entries")).alias("character_book"))
    rows = last.join(books.hint("merge"), who, "left")
    fields = [*[c for c in (*TEXTS, *LISTS) if c in versions.columns], "character_book"]
    names = F.concat(slugify(F.col("name")), F.lit("-"), slugify(F.col("handle")), F.lit(".json"))
    return rows.select("owner_id", "handle", names.alias("file"), card_v3(rows.select(*fields)).alias("json"))
