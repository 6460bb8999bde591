"""The dictionary of terms against a comparison with every term."""

import random

import pytest
from pyspark.sql import functions as F

from loquent.operators import lexical, terms
from tests.compare import same_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mangled(rng, word, n):
    for _ in range(min(n, len(word) - 1)):
        at = rng.randrange(len(word))
        new = rng.choice(["", rng.choice("abcé"), rng.choice("abcé") + word[at]])  # deleted, replaced, inserted
        word = word[:at] + new + word[at + 1 :]
    return word


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([3, 4, 5, 7, 8, 12, 13, 17, 18, 22, 23, 27, 28, 40, 60]))) for _ in range(150)]
    near = [mangled(rng, w, rng.randrange(1, 8)) for w in base for _ in range(4) if len(w) > 8 or rng.random() < 0.5]
    return sorted({w for w in base + near if len(w) > 1}), base


def test_expansion_equals_a_comparison_with_all_terms(spark, vocabulary):
    words, base = vocabulary
    postings = spark.createDataFrame([(i, "f", w, 1, 3) for i, w in enumerate(words)], "id int, field string, term string, tf int, length int")
    asked = [(n, f"{base[n]} {base[-n - 1]}") for n in range(60)]
    got = {}
    for r in terms.expand(lexical.dictionary(postings), spark.createDataFrame(asked, "query_id int, q string")).collect():
        got[r.query_id, r.asked, r.term] = round(r.weight, 9)
    want = {}
    for n, q in asked:
        own = list(dict.fromkeys(w for w in q.split() if len(w) > 1))
        for a in own:
            for w in words:
                gap = distance(a, w)
                if w == a:
                    want[n, a, w] = 1.0
                elif a == own[-1] and w.startswith(a):
                    want[n, a, w] = round(0.375 * len(w) / (len(w) + 0.3 * (len(w) - len(a))), 9)
                elif gap <= terms.edits(len(a)):
                    want[n, a, w] = round(0.45 * len(w) / (len(w) + gap), 9)
    assert got == want and sum(w not in (n, a) for n, a, w in want) > 200


def test_postings_are_read_by_a_list_of_terms(spark, tmp_path):
    docs = spark.range(500).select("id", F.concat_ws(" ", F.lit("common"), F.concat(F.lit("word"), F.col("id").cast("string"))).alias("text"))
    lexical.index(docs, ("text",)).write.parquet(str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    found = terms.expand(lexical.dictionary(postings), spark.createDataFrame([(0, "word12")], "query_id int, q string"))
    plan = terms.read_postings(postings, found)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [" in plan and "word12" in plan
    by_list = terms.read_postings(postings, found).count()
    many = spark.createDataFrame([(0, "wo")], "query_id int, q string")
    assert 20 < by_list < 60 and terms.read_postings(postings, terms.expand(lexical.dictionary(postings), many)).count() == 500


def test_fields_and_owners_narrow_a_search(spark):
    docs = spark.createDataFrame([(1, "red fox", "blue"), (2, "blue fox", "red"), (3, "red", "fox"), (4, None, "")], "id bigint, text string, name string")
    postings = lexical.index(docs, ("text", "name"))
    sizes, book = lexical.field_sizes(postings), lexical.dictionary(postings)
    asked = spark.createDataFrame([("a", "red fox"), ("b", "fox"), ("c", ""), ("d", None), ("e", "unknown")], "query_id string, q string")
    run = lambda **more: sorted((r.query_id, r.id) for r in terms.search_each(terms.matches_each(book, postings, sizes, asked, {"name": 6.0}, **more)).collect())
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]
    assert run(fields=["text"]) == [("a", 1), ("b", 1), ("b", 2)]
    assert run(within=spark.createDataFrame([(2,), (3,), (3,)], "id bigint")) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    matches = terms.matches_each(book, postings, sizes, asked, {})
    got = {(r.query_id, r.id, r.field): r.snippet for r in terms.field_snippets(terms.search_each(matches), matches, docs, ["text", "name"]).collect()}
    assert got["a", 2, "name"] == "red" and got["a", 2, "text"] == "blue fox" and got["b", 3, "name"] == "fox"


def test_an_empty_index(spark):
    postings = lexical.index(spark.createDataFrame([], "id bigint, text string"), ("text",))
    asked = spark.createDataFrame([("a", "red fox")], "query_id string, q string")
    assert terms.matches_each(lexical.dictionary(postings), postings, lexical.field_sizes(postings), asked, {}).count() == 0
    assert terms.suggest_each(lexical.dictionary(postings), asked).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_shuffled_once_and_equals_the_count_of_repeated_rows(spark):
    rows = [(1, "b a b the the the", "a b x"), (2, None, "x"), (3, "", None), (4, "q a q", "q")]
    docs = spark.createDataFrame(rows, "id bigint, text string, name string")
    shown = lambda df: sorted(tuple(r[c] for c in ("id", "field", "length", "term", "tf")) for r in df.collect())
    assert shown(lexical.index(docs.limit(0), ("text",))) == []
    docs = docs.select("id", *[F.regexp_replace(c, "([a-z])", "$1$1").alias(c) for c in ("text", "name")])  # words of two letters
    postings = lexical.index(docs, ("text", "name"))
    assert plan_of(postings).count("Exchange") == 1
    assert shown(postings) == [(1, "name", 3, "aa", 1), (1, "name", 3, "bb", 1), (1, "name", 3, "xx", 1), (1, "text", 6, "aa", 1), (1, "text", 6, "bb", 2), (1, "text", 6, "tthhee", 3), (2, "name", 1, "xx", 1), (4, "name", 1, "qq", 1), (4, "text", 3, "aa", 1), (4, "text", 3, "qq", 2)]
    twice = lexical.index(docs.unionByName(docs.filter("id = 1")), ("text", "name"))  # rows of one id add up
    assert {(r.id, r.field, r.term): r.tf for r in twice.collect()} == {(r.id, r.field, r.term): r.tf * (2 if r.id == 1 else 1) for r in postings.collect()}
    plain = postings.drop("first", "head")  # as if made elsewhere
    for made in (terms.words_of, lexical.field_sizes):
        norm = lambda df: sorted([tuple(sorted(map(tuple, v)) if isinstance(v, list) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()], key=repr)
        assert norm(made(postings)) == norm(made(plain))


def test_what_few_queries_ask_is_sent_to_an_index_that_stays_in_place(spark, tmp_path):
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("common"), F.concat(F.lit("wording"), F.col("id").cast("string"))).alias("text"))
    made = lexical.dictionary(lexical.index(docs, ("text",)))
    made.words.write.parquet(str(tmp_path / "w"))
    made.segments.write.parquet(str(tmp_path / "s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all were large
    try:
        book = terms.Dictionary(spark.read.parquet(str(tmp_path / "w")), spark.read.parquet(str(tmp_path / "s")))
        found = terms.expand(book, spark.createDataFrame([(0, "wording12 commom")], "query_id int, q string"))
        assert "SortMergeJoin" not in plan_of(found) and {"common", "wording12"} <= {r.term for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_terms_found_are_counted_by_bits_or_by_name(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox den"), (2, "red den"), (3, "fox fox")], "id bigint, text string")
    postings = lexical.index(docs, ("text",))
    sizes, book = lexical.field_sizes(postings), lexical.dictionary(postings)
    asked = spark.createDataFrame([("a", "red fox"), ("b", "den fox red")], "query_id string, q string")
    run = lambda: terms.matches_each(book, postings, sizes, asked, {})
    by_bits = run()
    assert plan_of(terms.search_each(by_bits)).count("Exchange hashpartitioning(query_id") == 2  # one, and one by query
    monkeypatch.setattr(terms, "BITS", 1)
    by_name = run()
    assert "bit" in by_bits.columns and "bit" not in by_name.columns
    assert terms.search_each(by_bits).collect() == terms.search_each(by_name).collect() and terms.search_each(by_bits).count() == 2


def test_reranking_broadcasts_its_pool_and_shuffles_no_documents(spark, sf):
    from loquent.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all were large
    try:
        assert "SortMergeJoin" not in plan_of(QUERIES["rerank_documents"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reranking_places_equal_scores_by_id(spark, tmp_path, monkeypatch):
    """The parts of a score are added in another order for the second document, which ends in another last place."""
    from loquent.plans.queries import QUERIES

    docs = spark.createDataFrame([(i, "heth ofth", "a") for i in (1, 2, 3)], "doc_id bigint, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    parts = [(0, i, a, 2, s) for i, order in ((1, (0.3, 0.2, 0.1)), (2, (0.1, 0.2, 0.3)), (3, (0.3, 0.2, 0.1))) for a, s in zip(("heth", "ofth", "ofth"), order)]
    found = spark.createDataFrame(parts, "query_id bigint, id bigint, asked string, terms int, score double").coalesce(1)
    sums = {r.id: r.s for r in found.groupBy("id").agg(F.sum("score").alias("s")).collect()}
    assert sums[1] < sums[2]
    monkeypatch.setattr(terms, "matches_each", lambda *args: found)
    assert [r.id for r in lexical.search(found, "heth ofth", {}, sizes=found, book=found).collect()] == [1, 2, 3]
    assert [r.id for r in QUERIES["rerank_documents"](spark, str(tmp_path)).orderBy("rank").collect()] == [1, 2, 3]


def test_reranking_splits_words_as_its_sql(spark, tmp_path):
    import duckdb

    from loquent.plans.queries import QUERIES, SQL

    gaps = [" ", "\u00a0", "\x0b", "\x1c", "\u3000", "\u0085", "\r\n", "\f\t"]
    docs = spark.createDataFrame([(i, f"heth{gap}ofth" + " more" * i, "a") for i, gap in enumerate(gaps)], "doc_id bigint, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(QUERIES["rerank_documents"](spark, str(tmp_path)), con, SQL["rerank_documents"])
