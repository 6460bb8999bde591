import base64
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from loquent.sources import cards, chats
from loquent.streaming import events


def png(card=None, keyword=b"chara"):
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0"))
    if card is not None:
        body += part(b"tEXt", keyword + b"\0" + base64.b64encode(json.dumps(card).encode()))
    return cards.SIGNATURE + body + part(b"IEND", b"")


def test_card_in_an_image(spark, tmp_path):
    (tmp_path / "Café Girl.png").write_bytes(png({"data": {"name": "Ana", "description": " ", "tags": ["x", 1, ""], "character_book": {"entries": {"a": 1}}}}))
    (tmp_path / "none.png").write_bytes(png())
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = cards.read_pngs(spark, str(tmp_path)).collect()
    assert [(r.name, r.description, r.tags, r.lore, r.handle) for r in got] == [("Ana", None, ["x"], 1, "cafe-girl")]


def test_later_keyword_wins_and_round_trip():
    image = png({"name": "old"})
    both = cards.with_card(image, json.dumps({"name": "new"}))
    assert cards.fields(cards.card_json(both))["name"] == "new"
    assert [k for k, _ in cards.chunks(both)].count(b"tEXt") == 1 and cards.chunks(both)[-1][0] == b"IEND"


def test_card_forms():
    assert cards.fields('{"char_name": "G", "char_persona": "p"}')["description"] == "p"
    assert cards.fields('{"name": "V1", "tags": "no list"}')["tags"] == []
    assert cards.fields("[]") is None and cards.fields("{") is None and cards.fields(None) is None


def test_card_export_reads_back(spark):
    df = cards.parsed(spark.createDataFrame([("d/a.json", json.dumps({"name": "Ana", "tags": ["x"]}))], "file string, json string"))
    again = cards.fields(df.select(cards.card_v3(df).alias("j")).first().j)
    assert again["name"] == "Ana" and again["tags"] == ["x"]
    assert df.select(cards.embed_text().alias("t")).first().t == "Name: Ana\nTags: x"


def test_versions(spark):
    stored = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2)], "handle string, import_hash string, version int")
    found = spark.createDataFrame([("a", "h2"), ("a", "h3"), ("b", "h9")], "handle string, import_hash string")
    assert sorted((r.handle, r.import_hash, r.version) for r in cards.next_versions(stored, found).collect()) == [("a", "h3", 3), ("b", "h9", 1)]


@pytest.fixture()
def chat_dir(tmp_path):
    d = tmp_path / "chats" / "Test Girl"
    d.mkdir(parents=True)
    head = {"user_name": "U", "character_name": "unused", "create_date": "2023-5-1 @12h 30m 5s"}
    lines = [json.dumps(head), json.dumps({"name": "T", "mes": "hello", "send_date": 1700000000, "swipes": ["hello", "hey"], "swipe_id": 1, "swipe_info": [{"send_date": 1700000000}]}), "{broken", json.dumps({"name": "U", "is_user": True, "mes": "hi", "swipes": ["hi"], "swipe_id": 0}), json.dumps({"is_system": True, "mes": "note", "extra": {"model": " ", "token_count": 5}})]
    (d / "main.jsonl").write_text("﻿" + "\r\n".join(lines), encoding="utf-8")
    (d / "main - Branch #1.jsonl").write_text(json.dumps(head | {"chat_metadata": {"main_chat": "main"}}))
    (d / "bad.jsonl").write_text("not json\n" + json.dumps({"mes": "lost"}))
    return str(tmp_path / "chats")


def test_chat_files(spark, chat_dir):
    lines = chats.read_lines(spark, chat_dir)
    heads, rows = chats.headers(lines), chats.messages(lines)
    assert {r.file_name for r in heads.collect()} == {"main.jsonl", "main - Branch #1.jsonl"}
    assert {(r.character_name, r.handle, r.created_at) for r in heads.collect()} == {("Test Girl", "test-girl", 1_682_944_205_000)}
    got = rows.orderBy("seq").collect()
    assert [(r.seq, r.role, r.content, r.active_variant) for r in got] == [(0, "assistant", "hello", 1), (1, "user", "hi", None), (2, "system", "note", None)]
    assert [(v.idx, v.content, v.sent_at) for v in got[0].variants] == [(0, "hello", 1_700_000_000_000), (1, "hey", None)]
    assert got[2].tokens == 5 and got[2].model is None
    assert sorted(r.kind for r in chats.kinds(heads, rows).collect()) == ["header_only", "real_conversation"]
    parents = {r.file_name: r.parent for r in chats.with_parents(heads).collect()}
    assert parents["main.jsonl"] is None and parents["main - Branch #1.jsonl"].endswith("main.jsonl")
    paired = chats.pair_with_cards(heads, spark.createDataFrame([("test-girl",), ("alone",)], "handle string"))
    assert {(r.handle, r.state) for r in paired.collect()} == {("test-girl", "paired"), ("alone", "card_only")}


def test_written_lines_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "a\nb"), (1, 1, "assistant", "c")], "chat_id bigint, seq bigint, role string, content string")
    d = tmp_path / "c" / "x"
    d.mkdir(parents=True)
    (d / "o.jsonl").write_text("\n".join(r.line for r in chats.write_lines(rows).orderBy("pos").collect()))
    got = chats.messages(chats.read_lines(spark, str(tmp_path / "c"))).orderBy("seq").collect()
    assert [(r.role, r.content) for r in got] == [("user", "a\nb"), ("assistant", "c")]


def test_second_import_adds_nothing(spark):
    found = spark.createDataFrame([("h1", 1), ("h1", 1), ("h2", 2)], "import_hash string, x int")
    assert chats.new_rows(found, found.limit(0)).count() == 2 and chats.new_rows(found, found).count() == 0


def test_streamed_counts_equal_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(str(src))
    ddl = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = events.event_stream(spark, str(src), ddl)
    for name, df, batch in (
        ("w", events.windowed(stream), table.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()),
        ("s", events.sessions(stream), table.groupBy(F.session_window(F.col("ts").cast("timestamp"), "30 minutes"), "user_id").count()),
    ):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
        assert sorted(r.n for r in spark.table(name).collect()) == sorted(r["count"] for r in batch.collect())
    events.unique(stream.union(stream)).writeStream.format("memory").queryName("u").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "u")).start().awaitTermination(120)
    assert spark.table("u").count() == table.count()
