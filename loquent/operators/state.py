"""New states of tables from changes: Parquet has no row updates, so each gives the whole new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose keys aren't in ``new``, and the rows of ``new``, each key once."""
    fresh = new.dropDuplicates(keys).select(stored.columns)
    return stored.join(fresh.select(keys), keys, "left_anti").select(stored.columns).unionByName(fresh)


def ensure(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and those of ``wanted`` whose keys they lack."""
    missing = wanted.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti")
    return stored.unionByName(missing.select(stored.columns))


def patch(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the values of ``changes`` where those aren't null."""
    fields = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = stored.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in stored.columns])


def copied_on_write(stored: DataFrame, changes: DataFrame, pinned: DataFrame, key: str = "id") -> DataFrame:
    """Versions after changes: a pinned version stays and a new one follows it, others change in place.

    stored: key, version and fields; changes: key and fields (null: as before); pinned: key and version.
    """
    last = stored.join(stored.groupBy(key).agg(F.max("version").alias("version")), [key, "version"])
    touched = last.join(changes.select(key), key, "left_semi")
    fixed = touched.join(pinned, [key, "version"], "left_semi")
    added = patch(fixed, changes, [key]).withColumn("version", (F.col("version") + 1).cast(dict(stored.dtypes)["version"]))
    loose = touched.join(pinned, [key, "version"], "left_anti")
    rest = stored.join(loose.select(key, "version"), [key, "version"], "left_anti")
    return rest.select(stored.columns).unionByName(patch(loose, changes, [key]).select(stored.columns)).unionByName(added.select(stored.columns))


def removed(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(keys).distinct(), keys, "left_anti").select(stored.columns)


def cascaded(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The tables after rows of a parent and all that name them went; children: table and its key column by name."""
    ids = gone.select(F.col(key)).distinct()
    out = {"parents": parents.join(ids, key, "left_anti")}
    for name, (child, column) in children.items():
        out[name] = child.join(ids.withColumnRenamed(key, column), column, "left_anti").select(child.columns)
    return out


def guarded(gone: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Of the rows to go, those that something still uses, and so must not."""
    return gone.join(uses.select(key).distinct(), key, "left_semi")


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Frames of a session after ``new`` ones came: these are numbered on from the last seq, in the order of ``pos``.

    stored: session_id, subpath, seq, uuid and more; new: the same but pos for seq. A frame whose uuid its session has
    already, or that repeats one before it in ``new``, is dropped; its number stays unused. Frames without a uuid all count.
    """
    keys = ["session_id", "subpath"]
    last = stored.groupBy(*keys).agg(F.max("seq").alias("__last"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    rows = new.join(last, keys, "left").withColumn("seq", (F.coalesce("__last", F.lit(-1)) + nth).cast(dict(stored.dtypes)["seq"]))
    again = F.row_number().over(Window.partitionBy(*keys, "uuid").orderBy("pos"))
    fresh = rows.withColumn("__again", again).filter(F.col("uuid").isNull() | (F.col("__again") == 1))
    known = stored.filter(F.col("uuid").isNotNull()).select(*keys, "uuid")
    return stored.unionByName(fresh.join(known, [*keys, "uuid"], "left_anti").select(stored.columns))


def compact_summaries(frames: DataFrame, newest: int = 10, mark: str = "session is being continued") -> DataFrame:
    """session_id and text of the latest among each session's ``newest`` frames of the user that says it goes on.

    frames: session_id, seq, type and entry, the JSON of a frame, whose message.content is text or a list of parts with text.
    """
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    recent = frames.filter("type = 'user'").withColumn("__rank", rank).filter(F.col("__rank") <= newest)
    v = F.try_variant_get(F.try_parse_json("entry"), "$.message.content", "variant")
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string"))
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.array_join(F.filter(parts, lambda x: x.isNotNull()), ""))
    said = recent.select("session_id", "seq", text.alias("text")).filter(F.lower("text").contains(mark))
    return said.groupBy("session_id").agg(F.max_by("text", "seq").alias("text"))


def rebuilt(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Asset rows (hash, size) with those added that files (hash, content) have no row for; files that aren't what their name says are left out."""
    sound = files.filter(F.sha2("content", 256) == F.col("hash")).select("hash", F.octet_length("content").cast(dict(rows.dtypes)["size"]).alias("size"))
    return rows.select("hash", "size").unionByName(sound.dropDuplicates(["hash"]).join(rows.select("hash"), "hash", "left_anti"))
