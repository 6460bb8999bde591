"""Characters imported with lorebooks, exported, and imported again."""

import json

import pytest
from pyspark.sql import functions as F

from loquent.sources import cards, transfer


def found(spark, rows):
    texts = spark.createDataFrame([(o, f, t) for o, f, t in rows], "owner_id int, file string, json string")
    parsed = cards.parsed(texts.select("file", "json"))
    return parsed.join(texts, "file").withColumn("import_hash", F.sha2("json", 256))


def card(name, entries=None, **more):
    book = {} if entries is None else {"character_book": {"entries": entries}}
    return json.dumps({"spec": "chara_card_v3", "data": {"name": name, "description": "d", "tags": ["t"], **more, **book}})


ENTRIES = [{"keys": ["moon", 3, "sea"], "content": "c1", "insertion_order": 5, "comment": "Title"}, {"keys": "no list", "enabled": False, "name": ""}, "no object", None, {"keys": ["k"], "enabled": "false", "insertion_order": "7", "content": 4}, {"insertion_order": "x"}]


def test_lore_entries_of_lists_and_objects(spark):
    rows = [("a", card("A", ENTRIES)), ("b", card("B", {"10": {"content": "ten"}, "2": {"content": "two"}, "x": {"content": "x"}})), ("c", card("C")), ("d", "no json"), ("e", json.dumps({"name": "flat", "character_book": {"entries": [{"content": "flat"}]}})), ("f", None), ("g", card("G", "text"))]
    got = {}
    for r in transfer.lore_entries(spark.createDataFrame(rows, "file string, json string")).collect():
        got.setdefault(r.file, []).append((r.pos, r.title, r["keys"], r.content, r.enabled, r.priority))
    assert got == {
        "a": [(0, "Title", ["moon", "sea"], "c1", True, 5.0), (1, "Untitled", [], "", False, 0.0), (2, "k", ["k"], "", True, 7.0), (3, "Untitled", [], "", True, 0.0)],
        "b": [(0, "Untitled", [], "two", True, 0.0), (1, "Untitled", [], "ten", True, 0.0), (2, "Untitled", [], "x", True, 0.0)],
        "e": [(0, "Untitled", [], "flat", True, 0.0)],
    }


@pytest.fixture
def first(spark):
    rows = [(1, "ann.json", card("Ann", ENTRIES[:1])), (1, "bob.json", card("Bob")), (2, "cy.json", card("Cy", ENTRIES[4:5])), (2, "bad.json", "{"), (2, "cy.JSON", card("Cy again"))]
    return rows, found(spark, rows)


def test_import_again_changes_only_what_differs(spark, first):
    rows, cards_ = first
    none = spark.createDataFrame([], "owner_id int, handle string, version int, import_hash string")
    made = transfer.import_cards(cards_, none)
    assert sorted((r.file, r.state, r.version) for r in made.report.collect()) == [("ann.json", "created", 1), ("bob.json", "created", 1), ("cy.JSON", "created", 1), ("cy.json", "repeated", 0)]
    assert [(r.handle, r.version, r.title) for r in made.lore.collect()] == [("ann", 1, "Title")]
    assert [r.file for r in transfer.unread(spark.createDataFrame([(f,) for _, f, _ in rows], "file string"), cards_).collect()] == ["bad.json"]
    again = transfer.import_cards(found(spark, [(1, "ann.json", rows[0][2]), (1, "bob.json", card("Bob", ENTRIES[4:5])), (3, "ann.json2", "{")][:2]), made.versions)
    assert sorted((r.handle, r.state, r.version) for r in again.report.collect()) == [("ann", "unchanged", 1), ("bob", "new version", 2)]
    assert [(r.handle, r.version, r["keys"]) for r in again.lore.collect()] == [("bob", 2, ["k"])]


def test_export_and_import_round_trip(spark, first):
    _, cards_ = first
    none = spark.createDataFrame([], "owner_id int, handle string, version int, import_hash string")
    made = transfer.import_cards(cards_, none)
    out = transfer.export_cards(made.versions, made.lore)
    files = {r.file: json.loads(r.json) for r in out.collect()}
    assert set(files) == {"ann-ann.json", "bob-bob.json", "cy-again-cy.json"}
    assert files["ann-ann.json"]["data"]["character_book"]["entries"] == [{"keys": ["moon", "sea"], "content": "c1", "enabled": True, "insertion_order": 5.0}]
    assert "character_book" not in files["bob-bob.json"]["data"]
    back = transfer.lore_entries(out.select("file", "json")).collect()
    assert [(r.file, r["keys"], r.content, r.priority) for r in back] == [("ann-ann.json", ["moon", "sea"], "c1", 5.0)]


def test_no_join_of_characters_is_a_broadcast(spark, sf):
    import __spark_entry__

    plan = __spark_entry__.queries()["character_lore"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    versions = spark.createDataFrame([(1, "a", 1, "A")], "owner_id int, handle string, version int, name string")
    lore = spark.createDataFrame([], "owner_id int, handle string, version int, pos int, keys array<string>, content string, enabled boolean, priority double")
    assert "Broadcast" not in transfer.export_cards(versions, lore)._jdf.queryExecution().executedPlan().toString()
