import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loquent.functions import digests
from loquent.operators import state, themes


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("so: " + json.dumps({"topicAnchor": " A ", "facts": ["f", 1], "keywords": [" k ", "", 2]}) + " ok", ("A\n- f", "A", ["k"])),
        ('{"topicAnchor": "cut sh', ("", None, [])),
        ("anchor\n- fact\nKEYWORDS: a, b; c\nmore", ("anchor\n- fact", "anchor", ["a", "b", "c"])),
        ("just text", ("just text", "just text", [])),
        ("", ("", None, [])),
    ],
)
def test_parse_digest(spark, raw, want):
    got = one(spark, digests.parse_digest, raw)
    assert (got.text, got.anchor, got.keywords) == want


def test_finish_reasons(spark):
    assert [one(spark, digests.finish_reason, x) for x in ("END_TURN", "odd", "", None)] == ["stop", "other", None, None]


def test_rewriting(spark):
    assert one(spark, lambda c: digests.rewritten(c, [(r"(?i)cat(s?)", "dog$1"), (r"\d+", "<{{match}}>")]), "Cats 12") == "dogs <12>"


def test_states(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, name string, version int")
    changes = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    assert sorted(map(tuple, state.patch(stored, changes, ["id"]).collect())) == [(1, "x", 1), (2, "b", 1)]
    pinned = spark.createDataFrame([(1, 1)], "id int, version int")
    got = state.copied_on_write(stored, spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string"), pinned)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "x", 2), (2, "y", 1)]
    wanted = spark.createDataFrame([(1, "z", 9), (3, "c", 1), (3, "c", 1)], "id int, name string, version int")
    assert sorted(r.id for r in state.ensure(stored, wanted, ["id"]).collect()) == [1, 2, 3]
    after = state.cascaded(stored, stored.filter("id = 1"), "id", {"kids": (spark.createDataFrame([(1, 5), (2, 6)], "parent int, x int"), "parent")})
    assert after["parents"].first().id == 2 and after["kids"].first().x == 6 and after["kids"].count() == 1
    assert state.guarded(stored, pinned, "id").count() == 1


def test_few_vectors_have_no_themes(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "h")], "id bigint, vec array<double>, content_hash string")
    assert themes.compute(rows, 3) is None


def test_frames_are_appended_once(spark):
    stored = spark.createDataFrame([("s", "main", 0, "u0", "a"), ("s", "main", 1, None, "b")], "session_id string, subpath string, seq bigint, uuid string, entry string")
    new = spark.createDataFrame([("s", "main", 0, "u0", "again"), ("s", "main", 1, "u1", "c"), ("s", "main", 2, "u1", "c"), ("s", "main", 3, None, "d"), ("t", "main", 0, "u0", "e")], "session_id string, subpath string, pos int, uuid string, entry string")
    got = sorted((r.session_id, r.seq, r.entry) for r in state.appended(stored, new).collect())
    assert got == [("s", 0, "a"), ("s", 1, "b"), ("s", 3, "c"), ("s", 5, "d"), ("t", 0, "e")]


def test_compact_summaries(spark):
    frame = lambda c: json.dumps({"message": {"content": c}})
    rows = [("s", 1, "user", frame("This session is being continued: old")), ("s", 2, "user", frame([{"text": "This Session is being continued"}, {"x": 1}, {"text": "new"}])), ("s", 3, "user", "no json"), ("t", 1, "assistant", frame("session is being continued"))]
    rows += [("u", 0, "user", frame("session is being continued"))] + [("u", i, "user", frame("x")) for i in range(1, 11)]
    got = state.compact_summaries(spark.createDataFrame(rows, "session_id string, seq int, type string, entry string")).collect()
    assert [(r.session_id, r.text) for r in got] == [("s", "This Session is being continuednew")]


def test_rows_are_rebuilt_from_sound_files(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = spark.createDataFrame([(sha(b"a"), 1)], "hash string, size bigint")
    files = spark.createDataFrame([(sha(b"a"), b"a"), (sha(b"bc"), b"bc"), (sha(b"bc"), b"bc"), ("0" * 64, b"bad")], "hash string, content binary")
    assert sorted((r.hash, r["size"]) for r in state.rebuilt(rows, files).collect()) == sorted([(sha(b"a"), 1), (sha(b"bc"), 2)])
