"""Answers from drafts to what is published, with backends that are asked once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attesto.operators import answers as A

KIND = "k string, t string"
SOURCES = "k string, source_id string, text string"


def reply(text, finish="stop"):
    return F.struct(F.lit(text).alias("text"), F.lit(finish).alias("finish"))


def test_paths(spark):
    """Drafts that hold, that are thought over, that stay refused, and questions without sources."""
    questions = spark.createDataFrame([("good", "draft"), ("late", "think"), ("cut", "cut"), ("room", "room"), ("never", None), ("none", "draft")], KIND)
    contexts = spark.createDataFrame([(k, s, t) for k in ("good", "late", "cut", "room", "never") for s, t in (("S10", "The tenth one."), ("S2", "The pump moves clean water. It is blue."))], SOURCES)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("struct<text:string,finish:string>")
    def draft(question, sources):
        calls.add(1)
        assert [s.source_id for s in sources] == ["S2", "S10"]  # by number
        return {"draft": ("The pump moves clean water [S2].", "stop"), "cut": ("The pump moves clean", "length"), "room": ("", "context_budget")}.get(question, ("Lions eat meat [S2].", "stop"))

    say = A.quoting(lambda s: s[1])
    think = lambda q, s: F.when(q == "think", say(q, s)).otherwise(reply("No."))
    got = {r.k: r for r in A.answered(questions, contexts, "k", "t", draft, think).collect()}
    assert {k: (r.path, r.refused, r.reason, r.text) for k, r in got.items()} == {
        "good": (["draft"], False, None, "The pump moves clean water [S2]."), "late": (["draft", "think"], False, None, "It is blue. [S2]"),
        "cut": (["draft", "think"], True, "nli_verification_failed", None), "room": (["draft"], True, "context_budget_exceeded", None),
        "never": (["draft", "think"], True, "nli_verification_failed", None), "none": ([], True, "no_sources", None),
    }
    assert calls.value == 5
    assert {r.k for r in A.answered(questions, contexts, "k", "t", draft).where("not refused").collect()} == {"good"}
    assert A.answered(questions.limit(0), contexts, "k", "t", draft, think).count() == 0


@pytest.mark.parametrize("text, finish", [("x", "done"), ("x", None), (None, "stop")])
def test_replies_that_are_none(spark, text, finish):
    bad = F.struct(F.lit(text).cast("string").alias("text"), F.lit(finish).cast("string").alias("finish"))
    q = spark.createDataFrame([("a", "q")], KIND)
    c = spark.createDataFrame([("a", "S1", "Some text.")], SOURCES)
    with pytest.raises(Exception, match="a backend must give"):
        A.answered(q, c, "k", "t", lambda *_: bad).collect()


def test_cases_by_a_list(spark):
    from attesto.sources.files import select_cases

    cases = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    assert sorted(r.n for r in select_cases(cases, "a, c\nother").collect()) == [1, 3]
    with pytest.raises(ValueError, match="none of the 2 ids"):
        select_cases(cases, "x y")
