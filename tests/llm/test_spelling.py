"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from loquent.llm import common, queries, spelling
from tests.compare import rows_of

SCHEMA = "doc_id bigint, text string"


def words_of(docs, least=7):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                count[word] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(docs):
    n, out = words_of(docs), []
    form = {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def same(spark, docs, **more):
    got = spelling.variants(spark.createDataFrame(docs, SCHEMA), **more)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert got.columns == columns
    assert rows_of(columns, got.collect()) == rows_of(columns, plain(docs))
    return got


@pytest.fixture(scope="module")
def crowded():
    """Few letters and many copies: hot blocks, chains of forms, words that differ at either end and in runs."""
    rng = random.Random(5)
    letters = "abé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 10))) for _ in range(150)]
    base += ["thequick" + x for x in ("ab", "abc", "abd", "bab", "b", "")] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaabaaa"]
    docs = []
    for i in range(160):
        text = [rng.choice(base).upper() if rng.random() < 0.2 else rng.choice(base) for _ in range(40)]
        docs.append((i % 150, " ".join(text)))
    chain = "common word".replace(" ", "")
    docs.append((500, f"{chain} " * 2000 + f"{chain[:-1]}x " * 150 + f"{chain[:-2]}yx " * 12))
    docs += [(501, None), (502, ""), (503, "×÷ÀÉ straße日本thequickab 🙂 a1b2"), (503, "a" * 3000 + " " + "a" * 2999 + " " + "b" + "a" * 2999), (504, "a" * 3000 + " " + "a" * 2999 + " " + "b" + "a" * 2999), (None, "thequickab thequickab")]
    return docs


@pytest.mark.parametrize("most", [256, 8, 2])
def test_variants_equal_plain_comparison(spark, crowded, most):
    got = same(spark, crowded, most=most)
    root = {r.word: r.root for r in got.collect()}
    assert root["commonwoyx"] == root["commonworx"] == "commonword"


def test_tables_of_words_are_not_broadcast(spark, crowded, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, written = [], spelling.materialize
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # as if all tables had more rows than may be broadcast
    monkeypatch.setattr(spelling, "materialize", lambda df: plans.append(plan(df)) or written(df))
    plans.append(plan(same(spark, crowded, most=8)))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_no_rows_and_clashing_columns(spark):
    same(spark, [])
    same(spark, [(1, "short it is")])
    docs = spark.createDataFrame([(1, "seventh seventh", "x", 3)], "doc_id bigint, text string, word string, n int")
    assert [tuple(r) for r in spelling.variants(docs).collect()] == [("seventh", None, "seventh", 2, 0, None)]


def test_query_equals_plain_comparison_of_its_words(spark, sf):
    """All words of the table; the near ones of each are looked up by deletions here."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = words_of(docs)
    by = {}
    for w in n:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(key, set()).add(w)
    near = {w: {v for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by[key] if v != w and one_edit(w, v)} for w in n}
    got = {r.word: r for r in queries.op13_spelling_variants(spark, sf).collect()}
    assert set(got) == set(n)
    for w, r in got.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        assert (r.n, r.n_near, r.form, r.form_n) == (n[w], len(near[w]), form, n.get(form))
        assert r.root == (got[form].root if form else w)
