"""Chat files of JSON lines: a header line, then one message a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.functions.text import null_if_blank, parent_of_branch, slugify, whole_name
from loquent.functions.values import date_to_ms


def read_lines(spark: SparkSession, path: str, names: str = "*.jsonl") -> DataFrame:
    """``lines_of`` every file under ``path`` whose name matches ``names``."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names)
    return lines_of(text.select(F.col("_metadata.file_path").alias("file"), "value"))


def lines_of(texts: DataFrame) -> DataFrame:
    """file, pos and the parsed line of texts (file, value); lines that aren't JSON have null.

    A file is one row until it is split, as its lines' order counts.
    """
    files = texts.select("file", F.regexp_replace("value", "^\\x{FEFF}", "").alias("value"))
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).filter(F.trim("line") != "")
    return lines.select("file", "pos", F.try_parse_json("line").alias("v"))


def _text(path: str, v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, "string")


def headers(lines: DataFrame) -> DataFrame:
    """One row per file whose header can be read: names, date, the chat it branched from, and the folder's slug."""
    first = lines.filter(F.col("pos") == 0).filter(F.col("v").isNotNull())
    name = F.element_at(F.split("file", "/"), -1)
    folder = F.url_decode(F.element_at(F.split("file", "/"), -2))
    character = null_if_blank(_text("$.character_name"))
    return first.select(
        "file",
        F.url_decode(name).alias("file_name"),
        F.when(character == "unused", folder).otherwise(F.coalesce(character, folder)).alias("character_name"),
        _text("$.user_name").alias("user_name"),
        date_to_ms(_text("$.create_date")).alias("created_at"),
        F.coalesce(whole_name(_text("$.chat_metadata.main_chat")), parent_of_branch(F.url_decode(name))).alias("parent_file"),
        slugify(folder).alias("handle"),
    )


def messages(lines: DataFrame) -> DataFrame:
    """One row per message of a file with a header: seq from 0, role, content, time, model, tokens and variants."""
    known = lines.filter((F.col("pos") == 0) & F.col("v").isNotNull()).select("file")
    rows = lines.filter((F.col("pos") > 0) & F.col("v").isNotNull()).join(known, "file", "left_semi")
    flag = lambda p: F.coalesce(F.try_variant_get("v", p, "boolean"), F.lit(False))
    swipes = F.try_variant_get("v", "$.swipes", "array<string>")
    info = F.try_variant_get("v", "$.swipe_info", "array<variant>")
    several = F.size(F.coalesce(swipes, F.array().cast("array<string>"))) > 1
    variants = F.transform(swipes, lambda x, i: F.struct(i.cast("int").alias("idx"), x.alias("content"), date_to_ms(F.try_variant_get(F.get(info, i), "$.send_date", "string")).alias("sent_at")))
    chosen = F.try_variant_get("v", "$.swipe_id", "int")
    tokens = F.try_variant_get("v", "$.extra.token_count", "double")
    return rows.select(
        "file",
        (F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1).alias("seq"),
        F.when(flag("$.is_system"), "system").when(flag("$.is_user"), "user").otherwise("assistant").alias("role"),
        _text("$.name").alias("name"),
        F.coalesce(_text("$.mes"), F.lit("")).alias("content"),
        date_to_ms(_text("$.send_date")).alias("created_at"),
        null_if_blank(_text("$.extra.model")).alias("model"),
        null_if_blank(_text("$.extra.api")).alias("provider"),
        F.when(tokens > 0, tokens.cast("long")).alias("tokens"),
        F.when(several, variants).alias("variants"),
        F.when(several & chosen.between(0, F.size(swipes) - 1), chosen).alias("active_variant"),
    )


def kinds(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """What each file holds: a header alone, messages without text, a greeting alone, or a conversation."""
    full = F.trim("content") != ""
    per = rows.groupBy("file").agg(F.count("*").alias("n"), F.count_if(full).alias("full"), F.count_if(full & (F.col("role") == "user")).alias("asked"))
    kind = F.when(F.coalesce("n", F.lit(0)) == 0, "header_only").when(F.col("full") == 0, "all_empty_msgs").when(F.col("asked") == 0, "greeting_only").otherwise("real_conversation")
    return heads.select("file").join(per, "file", "left").select("file", kind.alias("kind"))


def with_parents(heads: DataFrame) -> DataFrame:
    """Files with the file of the same handle that they branched from; none for themselves."""
    up = heads.select(F.col("handle").alias("__h"), F.col("file_name").alias("__n"), F.col("file").alias("parent"))
    found = (F.col("handle") == F.col("__h")) & (F.col("parent_file") == F.col("__n")) & (F.col("file") != F.col("parent"))
    return heads.join(up, found, "left").drop("__h", "__n")


def pair_with_cards(heads: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards (handle) and chat folders by handle: paired, card only or chats only."""
    folders = heads.groupBy("handle").agg(F.count("*").alias("chats"))
    both = cards.select("handle").distinct().withColumn("card", F.lit(True)).join(folders, "handle", "full_outer")
    state = F.when(F.col("card").isNull(), "chats_only").when(F.col("chats").isNull(), "card_only").otherwise("paired")
    return both.select("handle", F.coalesce("chats", F.lit(0)).alias("chats"), state.alias("state"))


def new_rows(found: DataFrame, stored: DataFrame, key: str = "import_hash") -> DataFrame:
    """Rows that weren't imported before, each hash once: a second import adds nothing."""
    return found.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def write_lines(rows: DataFrame, user: str = "User", char: str = "Character") -> DataFrame:
    """chat_id, pos and line: the lines of a chat file, in its order; variants only where there are several."""
    head = rows.select("chat_id").distinct().select("chat_id", F.lit(0).alias("pos"), F.to_json(F.struct(F.lit(user).alias("user_name"), F.lit(char).alias("character_name"))).alias("line"))
    name = F.when(F.col("role") == "user", user).otherwise(char)
    extra = [F.col("variants.content").alias("swipes"), F.col("active_variant").alias("swipe_id")] if "variants" in rows.columns else []
    line = F.struct(name.alias("name"), (F.col("role") == "user").alias("is_user"), (F.col("role") == "system").alias("is_system"), F.col("content").alias("mes"), *extra)
    body = rows.select("chat_id", (F.col("seq") + 1).cast("int").alias("pos"), F.to_json(line).alias("line"))
    return head.unionByName(body)


def write_files(lines: DataFrame, path: str) -> None:
    """``write_lines`` as a text file for each chat, in a folder of its own."""
    dealt = lines.repartition("chat_id").sortWithinPartitions("chat_id", "pos")
    dealt.select("chat_id", "line").write.partitionBy("chat_id").text(path)
