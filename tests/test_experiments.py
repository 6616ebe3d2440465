"""Golden values of the experiment operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attesto import plans
from attesto.functions import text as T
from attesto.operators import experiments as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_score_answers(spark):
    kind = "id string, answer string, facts array<string>, expected string"
    refusal = "In the documents there is no answer to this question."
    rows = [
        ("right", "It is Forty two", ["forty two|42"], "answer"), ("wrong", "It is 41", ["42"], "answer"), ("refuses", refusal, ["42"], "answer"), ("empty", None, ["42"], "answer"),
        ("abstains", "This is not specified.", [], "refusal"), ("invents", "It is 7", [], "refusal"),
        ("corrects", "No, it is 5", ["5"], "refusal_or_correction"), ("yields", "Yes", ["5"], "refusal_or_correction"),
    ]
    got = {r.id: (r.refused, r.abstained, r.correct, r.hallucination) for r in X.score_answers(spark.createDataFrame(rows, kind), "answer", "facts", "expected", refusal).collect()}
    assert got == {
        "right": (False, False, True, None), "wrong": (False, False, False, None), "refuses": (True, True, False, None), "empty": (True, True, False, None),
        "abstains": (False, True, True, False), "invents": (False, False, False, True), "corrects": (False, False, True, False), "yields": (False, False, False, True),
    }


def test_code_spans(spark):
    found = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(T.code_span("a", "b").alias("x")).first()["x"]
    assert found("The rule reads list-item: list-item = name / quoted-name", "see list-item=name/quoted-name there")
    assert not found("plain prose that is long enough here", "plain prose that is long enough here")
    assert not found("a = b", "a = b") and not found("list-item = name / other", "see list-item=name/quoted-name there")


def test_negate(spark):
    assert one(spark, X.negate("t"), "The title must change") == "The title must not change"
    assert one(spark, X.negate("t"), "It is not so") == "It is so"
    assert one(spark, X.negate("t"), "Это не так") == "Это так"
    assert one(spark, X.negate("t"), "nothing here") is None


def test_titles(spark):
    assert one(spark, X.title("t"), "<html><title>A  B | Site</title>") == "A B"
    assert one(spark, X.title("t"), "Request for Comments: 9110\n\nHTTP Semantics\n\nAbstract\n") == "RFC 9110: HTTP Semantics"
    assert one(spark, X.title("t"), "12\n# The  title\ntext") == "The  title"
    assert one(spark, X.title("t"), "1 2") is None


def test_context_skips_what_does_not_fit(spark):
    s = spark.createDataFrame([("q", i, n) for i, n in enumerate([50, 80, 40, 10])], "q string, i int, n int")
    assert [r.included for r in X.pack_context(s, "q", "i", "n", 100).orderBy("i").collect()] == [True, False, True, True]


def test_gate_calibration(spark):
    s = spark.createDataFrame([(0.1, False), (0.2, False), (0.3, True), (0.35, False), (0.6, True), (0.9, True)], "s double, a boolean")
    r = X.calibrate_gate(s, "s", "a", 0.0).first()
    assert r.threshold == pytest.approx(0.25) and r.rejection == pytest.approx(2 / 3)


def test_sentence_chunks(spark):
    from attesto.config import Chunking

    text = " ".join(f"Sentence number {i} is here." for i in range(30)) + " " + "word " * 60 + "."
    rows = X.sentence_chunks(spark.createDataFrame([("d", text)], "k string, t string"), "k", "t", Chunking(30, 50, 7)).collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) - len(good) == 1 and [r.ordinal for r in good] == list(range(len(good))) and all(r.tokens <= 50 for r in good)
    assert all(b.text.startswith(a.text.rsplit(". ", 1)[1]) for a, b in zip(good, good[1:]))


def test_judge_and_calibration(spark):
    rows = [(float(i % 7), float(i % 3), i % 7 + i % 3 > 4, i // 3) for i in range(210)]
    df = spark.createDataFrame(rows, "a double, b double, y boolean, g int")
    model = X.fit_judge(df, ["a", "b"], "y", "g", grid=(0.01,), folds=3)
    assert model.coefficients[0] > 0 and model.coefficients[1] > 0
    iso = X.isotonic(df, "a", "y").select("a", "calibrated").distinct().orderBy("a").collect()
    assert [r.calibrated for r in iso] == sorted(r.calibrated for r in iso)


def test_replacement_needs_a_partner(spark):
    base = spark.createDataFrame([(1, True, False), (2, True, False), (3, False, False)], "id int, refused boolean, ok boolean")
    other = spark.createDataFrame([(1, True), (3, True)], "id int, ok boolean")
    got = {r.id: r.ok for r in X.replaced(base, other, "id", F.col("refused"), ["ok"]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_transplants_and_quotes_of_all_documents(spark, tmp_path):
    docs = [(i, f"first line of {i}\nthe passage number {i} stands in the middle of it\nlast line", "de" if i % 5 == 3 else "en", "abc"[i * i % 7 % 3]) for i in range(1, 40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, (i, _, lang, source) in enumerate(docs):
        ring = docs[k + 1 :] + docs[:k]
        want[i] = next(x[0] for x in ring if x[2] == lang and x[3] != source)
    assert {r.doc_id: r.partner for r in plans.QUERIES["transplant_partner"](spark, str(tmp_path)).collect()} == want
    assert {r.quote_id for r in plans.QUERIES["quote_binding"](spark, str(tmp_path)).collect()} == set(want)


def test_near_duplicate_docs_by_brute_force(spark, tmp_path):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 60)}" for _ in range(r.randint(1, 30))] for _ in range(12)]
    texts = [" ".join(w if r.random() > 0.06 else f"x{r.randint(0, 9)}" for w in base[i % 12]) for i in range(120)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: set(t.split()) for i, t in enumerate(texts) if t}
    want = {(a, b, round(len(x & y) / len(x | y), 6)) for a, x in sets.items() for b, y in sets.items() if a < b and 5 * len(x & y) >= 4 * len(x | y)}
    got = [tuple(x) for x in plans.QUERIES["near_duplicate_docs"](spark, str(tmp_path)).collect()]
    assert len(want) > 50 and len(got) == len(want) and set(got) == want


def test_sentence_windows_of_documents(spark, tmp_path):
    spark.createDataFrame([(7, "One is here. Two is here.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in plans.QUERIES["sentence_windows"](spark, str(tmp_path)).collect()} == {7}


def test_blocks_of_sites(spark, tmp_path):
    pages = [(i, f"http://a.org/{i}", f"<p>Menu</p><script>var x;</script><p>text {i}</p>") for i in range(3)] + [(9, "http://b.org", "<p>Menu</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in plans.QUERIES["page_repeated_blocks"](spark, str(tmp_path)).collect()] == [("a.org", "menu", 3)]


def test_titles_and_turns_of_all_rows(spark, tmp_path):
    spark.createDataFrame([(1, "# One title\r\ntext\r\n"), (2, "Two\ntext")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in plans.QUERIES["document_titles"](spark, str(tmp_path)).collect()} == {(1, "One title"), (2, "Two")}
    turns = [(1, 0, "Это не так"), (1, 1, "да, yes sir"), (1, 2, "not so")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.latin, r.script, r.negated) for r in plans.QUERIES["turn_features"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, "ru", True), 1: (6, "en", False), 2: (5, "en", True)}


def test_overlaps_are_tried_on_the_ends(spark):
    """What each length is tried on is as long as the longest overlap, however long the texts are."""
    texts = [("x" * 1000 + "abc", "abc" + "y" * 1000), ("aaa", "aa"), ("", "b"), ("ab", "cd"), (None, "a")]
    merged = X.overlap_merged("a", "b", 100)
    assert [r.t for r in spark.createDataFrame(texts, "a string, b string").select(merged.alias("t")).collect()] == ["x" * 1000 + "abc" + "y" * 1000, "aaa", "b", "abcd", None]
    assert "right(a, 100)" in str(merged) and "left(b, 100)" in str(merged)


def test_quotes_travel_with_their_chunk_once(spark):
    """Runs aren't made before they are searched: a chunk's text is dealt and sorted once, and only hits are."""
    chunks = spark.createDataFrame([("d", 0, "One two"), ("d", 1, None), ("d", 2, "three  FOUR"), ("d", 3, "one two"), ("e", 0, "one two")], "document_id string, ordinal int, text string")
    quotes = spark.createDataFrame([(1, "d", "two three"), (2, "d", "one two"), (3, "d", "four one"), (4, "d", "two two"), (5, "e", "one"), (6, "d", None)], "quote_id int, document_id string, quote string")
    df = X.bind_quotes(chunks, quotes)
    assert sorted(map(tuple, df.collect())) == [(1, 0, 2), (2, 0, 0), (2, 3, 3), (3, 2, 3), (5, 0, 0)]
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
