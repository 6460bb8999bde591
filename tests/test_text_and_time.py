import pytest
from pyspark.sql import functions as F

from loquent.functions import text, values


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "ms"),
    [
        ("1700000000", 1_700_000_000_000),
        ("1700000000000", 1_700_000_000_000),
        ("2023-05-01T12:30:05Z", 1_682_944_205_000),
        ("2023-05-01 12:30:05", 1_682_944_205_000),
        ("2023-5-1 @12h 30m 5s 123ms", 1_682_944_205_000),
        ("May 1, 2023 12:30pm", 1_682_944_200_000),
        ("May 1, 2023", 1_682_899_200_000),
        ("soon", None),
        ("", None),
        (None, None),
        ("12", None),
    ],
)
def test_dates(spark, value, ms):
    assert one(spark, values.date_to_ms, value) == ms


@pytest.mark.parametrize(("value", "ms"), [(1.7e9, 1_700_000_000_000), (1.7e12, 1_700_000_000_000), (0.0, None), (-5.0, None), (float("nan"), None), (None, None)])
def test_epochs(spark, value, ms):
    assert one(spark, values.epoch_to_ms, value, "double") == ms


@pytest.mark.parametrize(("value", "items"), [('["a", 1, null, "b"]', ["a", "b"]), ("not json", []), ('{"a": 1}', []), (None, []), ("[]", [])])
def test_lenient_lists(spark, value, items):
    assert one(spark, values.string_items, value) == items


@pytest.mark.parametrize(("value", "want"), [("The Moonlit Orchard", "moonlit orchard"), ("body transformation!", "body transformation"), ("  Glitter-chan  ", "glitter-chan"), ("cat", None), (None, None)])
def test_keywords(spark, value, want):
    assert one(spark, text.normalize_keyword, value) == want


def test_clean_text(spark):
    assert one(spark, text.clean_text, " <b>a</b>\t\tb \n\n\n\n c ") == "a b\n\nc"


def test_tokens(spark):
    assert one(spark, text.estimate_tokens, "abcde") == 2 and one(spark, text.estimate_tokens, "日本ab") == 3
    assert one(spark, text.approx_tokens, "x" * 367) == 100


def test_names_and_slugs(spark):
    assert one(spark, lambda c: text.with_names(c, "A$1", "B"), "{{char}} and {{User}}") == "A$1 and B"
    assert [one(spark, text.slugify, x) for x in ("Café Noir!", "  ", "Ａbc 1")] == ["cafe-noir", "unnamed", "abc-1"]
    assert one(spark, text.parent_of_branch, "Tale - Branch #2.jsonl") == "Tale.jsonl"
    assert one(spark, text.whole_name, "main") == "main.jsonl"


def test_whole_words(spark):
    assert one(spark, lambda c: text.has_word(c, "C++"), "I like c++ a lot") and not one(spark, lambda c: text.has_word(c, "art"), "smart")


def test_snippets(spark):
    got = one(spark, lambda c: text.snippet_around(c, ["needle"], 5), "hay " * 10 + "needle" + " hay" * 10)
    assert "needl" in got and got.startswith("…") and got.endswith("…")
    assert one(spark, lambda c: text.snippet_around(c, ["nothing"]), "short") == "short"
    assert one(spark, text.strip_think, "<think>a\nb</think> c") == "c"


def test_cosine_of_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(values.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


def test_snippet_flattens_a_text_once_however_many_terms(spark):
    rows = spark.createDataFrame([("a  long\n text " * 40 + "Needle", ["zzz", "needle", "none"]), ("  Only\tthis ", ["x"]), (None, ["x"])], "t string, ws array<string>")
    out = rows.select(text.snippet_of(F.coalesce("t", F.lit("")), F.col("ws"), 5).alias("s"))
    assert [r.s for r in out.collect()] == ["…text Needle", "Only this", ""]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
