import hashlib

from pyspark.sql import functions as F

from loquent.operators import dedupe, embeds, keywords


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_only_due_rows_are_encoded(spark):
    stored = spark.createDataFrame(
        [(1, [9.0], digest(b"same"), 1, "old"), (2, [9.0], digest(b"was"), 1, "old"), (3, None, digest(b"three"), 1, "old"), (5, [9.0], digest(b"gone"), 1, "old")],
        "id int, vec array<double>, content_hash string, tokens bigint, model string",
    )
    rows = spark.createDataFrame([(1, "same"), (2, "is now longer"), (3, "three"), (4, "no vector"), (6, None), (7, "")], "id int, text string")
    encoder = lambda texts: [None if t.startswith("no") else [len(t), 1] for t in texts]
    got = {r.id: (r.vec, r.content_hash, r.tokens, r.model) for r in embeds.embed_and_upsert(rows, stored, ["id"], encoder, model="new").collect()}
    assert got == {
        1: ([9.0], digest(b"same"), 1, "old"),
        2: ([13.0, 1.0], digest(b"is now longer"), 3, "new"),
        3: ([5.0, 1.0], digest(b"three"), 1, "new"),
        5: ([9.0], digest(b"gone"), 1, "old"),
        7: ([0.0, 1.0], digest(b""), 0, "new"),
    }


def test_images_are_encoded_too(spark):
    stored = spark.createDataFrame([], "asset string, vec array<double>, content_hash string, tokens bigint, model string")
    images = spark.createDataFrame([("a", b"\x01\x02"), ("b", None)], "asset string, content binary")
    got = embeds.embed_and_upsert(images, stored, ["asset"], lambda xs: [[float(sum(x))] for x in xs], "content").collect()
    assert [(r.asset, r.vec, r.tokens) for r in got] == [("a", [3.0], None)]


def test_pairs_of_an_owner_are_limited_in_it(spark):
    rows = spark.createDataFrame([(i, o, "c", ["alpha", "beta", "gamma"][: 2 + (i % 2)]) for i in range(6) for o in (1, 2)], "digest_id int, owner_id int, character_id string, keywords array<string>")
    rows = rows.withColumn("digest_id", F.col("digest_id") * 10 + F.col("owner_id"))
    got = sorted((r.owner_id, r.a, r.b, r.n) for r in keywords.cooccurrence(keywords.keyword_rows(rows), most=1, scope="owner_id").collect())
    assert got == [(1, "alpha", "beta", 6), (2, "alpha", "beta", 6)]


def test_reads_of_duplicates(spark):
    pairs = spark.createDataFrame([(1, 2, 1, 0.9, "forked"), (1, 3, 1, 0.5, "duplicate"), (4, 5, 2, 0.7, "duplicate"), (1, 6, 1, 0.2, "duplicate")], "a int, b int, owner_id int, jaccard double, relation string")
    read = lambda **more: [(r.a, r.b) for r in dedupe.read_duplicates(pairs, **more).collect()]
    assert read() == [(4, 5), (1, 3)] and read(include_forked=True, owner=1) == [(1, 2), (1, 3)] and read(least=0.1, limit=2) == [(4, 5), (1, 3)]
