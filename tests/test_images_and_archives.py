import io
import shutil
import zipfile

from pyspark.sql import functions as F

from loquent.operators import images, search, vectors, views
from loquent.sources import archives, scratch


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<double>")


def test_nearest_each_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)] + [(40, None)]
    df = vectors_of(spark, rows)
    got = vectors.nearest_each(df.filter("id % 10 = 0").withColumnRenamed("id", "query_id"), df, 3).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {q: [i for _, i in sorted((round(1 - cos(rows[q][1], v), 9), i) for i, v in rows if v and i != q)[:3]] for q in (0, 10, 20, 30)}
    for q, ids in want.items():
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: (round(r.distance, 9), r.id))] == ids
    assert vectors.nearest_each(df.limit(0).withColumnRenamed("id", "query_id"), df, 3).count() == 0


def test_image_search_fans_out_and_keeps_the_unused(spark):
    held = vectors_of(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])])
    versions = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "character_id bigint, asset_id bigint")
    asked = spark.createDataFrame([(99, [1.0, 0.0])], "query_id bigint, vec array<double>")
    got = images.image_search(held, versions, asked, 2).collect()
    assert sorted((r.rank, r.id, r.character_id or 0) for r in got) == [(1, 1, 10), (1, 1, 11), (2, 2, 0)]
    assert sorted(r.character_id for r in images.avatars(held, versions).collect()) == [10, 11]


def test_similar_art_leaves_the_character_out(spark):
    held = spark.createDataFrame([(10, 1, [1.0, 0.0]), (11, 1, [1.0, 0.0]), (12, 2, [0.9, 0.1]), (13, 3, [0.0, 1.0])], "character_id bigint, asset_id bigint, vec array<double>")
    got = images.similar_art(held, spark.createDataFrame([(10,), (13,)], "character_id bigint"), 2).collect()
    assert sorted((r.query_id, r.rank, r.character_id) for r in got) == [(10, 1, 11), (10, 2, 12), (13, 1, 12), (13, 2, 10)]


def test_archetypes_cluster_images_and_not_each_character(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(images, "kmeans", lambda rows, k, seed, weight: (seen.append(rows), [(0, [1.0, 0.0]), (1, [0.0, 1.0])])[1])
    held = spark.createDataFrame([(c, c % 3, [1.0, 0.1 * (c % 3)] if c % 3 else [0.0, 1.0]) for c in range(90)], "character_id bigint, asset_id bigint, vec array<double>")
    facets = spark.createDataFrame([(c, "g", "t") for c in range(90)], "character_id bigint, genre string, tone string")
    got = {r.cluster: (r["size"], r.members[:2]) for r in images.visual_archetypes(held, facets, 2).collect()}
    assert got == {0: (60, [1, 2]), 1: (30, [0, 3])} and sorted((r.id, r.n) for r in seen[0].collect()) == [(0, 30), (1, 30), (2, 30)]


def test_similar_art_where_very_many_share_an_image(spark):
    """Three images at one distance of the asker's; characters of least id count, though one has them on the last image."""
    at = {0: [1.0, 0.0, 0.0, 0.0], 1: [0.0, 1.0, 0.0, 0.0], 2: [0.0, 0.0, 1.0, 0.0], 3: [0.0, 0.0, 0.0, 1.0]}
    who = [(100, 0)] + [(c, 1) for c in range(40, 60)] + [(c, 2) for c in range(20, 40)] + [(c, 3) for c in range(20)]
    held = spark.createDataFrame([(c, a, at[a]) for c, a in who], "character_id bigint, asset_id bigint, vec array<double>")
    asked = spark.createDataFrame([(100,), (5,)], "character_id bigint")
    out = images.similar_art(held, asked, 2)
    assert sorted((r.query_id, r["rank"], r.character_id) for r in out.collect()) == [(5, 1, 0), (5, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert "(nth" in out._jdf.queryExecution().optimizedPlan().toString()  # no more than three characters of an image meet an asker


def test_visual_archetypes_name_their_styles(spark):
    held = spark.createDataFrame([(i, i, [1.0, i % 2 * 5.0]) for i in range(20)], "character_id bigint, asset_id bigint, vec array<double>")
    facets = spark.createDataFrame([(i, "noir" if i % 2 else None, "dark" if i % 2 else "") for i in range(20)], "character_id bigint, genre string, tone string")
    got = {r.label: (r["size"], r.members[:2]) for r in images.visual_archetypes(held, facets, 2).collect()}
    assert got == {"dark noir": (10, [1, 3]), "mixed": (10, [0, 2])}
    assert images.visual_archetypes(held.limit(2), facets, 2) is None


def test_mid_times_of_spans(spark):
    digests = spark.createDataFrame([(1, 0, 0, 0, 3, None), (1, 0, 1, 4, 5, 7), (2, 0, 0, 0, 9, None)], "chat_id bigint, tier int, block_idx int, seq_start bigint, seq_end bigint, mid_at bigint")
    rows = spark.createDataFrame([(1, i, 100 + i) for i in range(6)], "chat_id bigint, seq bigint, created_at bigint")
    assert [(r.chat_id, r.block_idx, r.mid_at) for r in views.mid_times(digests, rows).collect()] == [(1, 0, 102)]


def test_reranked_pools_put_the_unscored_last(spark):
    hits = spark.createDataFrame([(1, "a b", 1), (2, "x", 2), (3, "a", 3)], "id int, text string, place int")
    scorer = lambda q, t: t.map(lambda x: None if x == "x" else float(len(x))).astype("float64")
    assert [r.id for r in search.reranked(hits, "a b", "text", 3, scorer).orderBy("rank").collect()] == [1, 3, 2]


def test_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as held:
        held.writestr("a/b.jsonl", "one")
        held.writestr("../up.txt", "two")
        held.writestr("/root.txt", "three")
    (tmp_path / "x.zip").write_bytes(out.getvalue())
    (tmp_path / "y.zip").write_bytes(b"no archive")
    got = archives.read_zips(spark, str(tmp_path)).collect()
    assert sorted((r.file, bytes(r.content or b""), r.state) for r in got) == [("", b"", "unreadable"), ("../up.txt", b"", "unsafe"), ("/root.txt", b"", "unsafe"), ("a/b.jsonl", b"one", "ok")]
    assert not archives.safe_name("c:/x") and archives.safe_name("x/y..z")


def test_stored_tables_are_built_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    built = []
    build = lambda df: built.append(1) or df.withColumn("twice", F.col("id") * 2)
    for _ in range(2):
        assert scratch.stored("twice", spark.read.parquet(str(tmp_path / "t")), build).agg(F.sum("twice")).first()[0] == 20
    assert built == [1]
    shutil.rmtree(next(path for key, path in scratch._STORED.items() if "twice" in key).removeprefix("file:"))
    assert scratch.stored("twice", spark.read.parquet(str(tmp_path / "t")), build).count() == 5 and built == [1, 1]
