"""Operators against plain Python over whole tables, and rules of theirs that the tables don't meet."""

from __future__ import annotations

import hashlib
import io
import os
import re
import subprocess
import sys
import time
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesto import plans
from attesto.config import Chunking, Judge, Rules
from attesto.functions import text as T
from attesto.operators import claims as C
from attesto.operators import evaluate as E
from attesto.operators import experiments as X
from attesto.operators import parse as P
from attesto.operators import retrieval as R
from attesto.operators import runs as N
from attesto.operators import summarize as M
from attesto.operators import tables as B
from attesto.operators.html import html_text
from attesto.sources import files, store
from attesto.storage import Workspace


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Whole tables.


def naive_chunks(elements, name, config):
    """Chunks by counting each candidate's whole text anew."""
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))

    def shown(path, parts, notes):
        return f"Документ: {name}\nРаздел: {' > '.join(path)}\n" + "\n".join([*parts, *dict.fromkeys(notes)])

    out, held = [], []
    show = lambda items: shown(items[0].path, [e.text for e in items], [n for e in items for n in e.data.get("notes", ())])
    for e in elements:
        if held and (held[0].path != e.path or e.kind == "table"):
            out.append(show(held))
            held = []
        if e.kind == "table":
            lines = e.text.split("\n")
            head, rows = [t for t in [e.data.get("caption") or e.data.get("title")] if t] + lines[:2], lines[2:]
            some = []
            for row in rows:
                if some and count(shown(e.path, [*head, *some, row], e.data["notes"])) > config.most:
                    out.append(shown(e.path, head + some, e.data["notes"]))
                    some = []
                some.append(row)
            if some or not rows:
                out.append(shown(e.path, head + some, e.data["notes"]))
            continue
        if held and count(show([*held, e])) > config.most:
            out.append(show(held))
            held = []
        if count(show([e])) <= config.most:
            held.append(e)
            if count(show(held)) >= config.target:
                out.append(show(held))
                held = []
            continue
        words = [m.start() for m in re.finditer(r"\w+|[^\w\s]", e.text)] + [len(e.text)]
        a = 0
        while True:
            b = max(k for k in range(a, len(words)) if k == a or count(shown(e.path, [e.text[0 if a == 0 else words[a] : words[k]]], e.data["notes"])) <= config.most)
            out.append(shown(e.path, [e.text[0 if a == 0 else words[a] : words[b]]], e.data["notes"]))
            if b == len(words) - 1:
                break
            a = max(a + 1, b - config.overlap)
    return out + ([show(held)] if held else [])


def test_chunks_of_all_documents(spark, sf):
    got = {}
    for r in plans.QUERIES["chunk_documents"](spark, sf).collect():
        got.setdefault(r.doc, []).append((r.ordinal, r.sha, r.token_count, r.oversized))
    some = {d: t for d, t in texts(spark, sf).items() if len(t) < 6000}  # the naive way is quadratic; all but the longest
    assert len(some) > 700
    for d, t in some.items():
        want = naive_chunks(P.parse(t), str(d), Chunking())
        count = [len(re.findall(r"\w+|[^\w\s]", c)) for c in want]
        assert sorted(got[str(d)]) == [(i, hashlib.sha256(c.encode()).hexdigest(), n, n > 600) for i, (c, n) in enumerate(zip(want, count))]


def test_sentence_chunks_of_all_documents(spark, sf):
    got = {}
    for r in plans.QUERIES["sentence_chunks"](spark, sf).collect():
        if r.error is None:
            got.setdefault(r.doc, {})[r.ordinal] = r.sha
    count = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    for d, t in texts(spark, sf).items():
        want, held, fresh = [], [], False
        for s in (x.strip() for x in re.split(r"(?<=[.!?。！？])\s+(?=[A-ZА-ЯЁ0-9«\"“(])|\n+", t)):
            if not s or count(s) > 800:
                continue
            if fresh and sum(map(count, held)) + count(s) > 300:
                want.append(" ".join(held))
                k = len(held)
                while k and sum(map(count, held[k - 1 :])) <= 75:
                    k -= 1
                held = held[k:]
                held = held if sum(map(count, held)) + count(s) <= 800 else []
            held, fresh = [*held, s], True
        want += [" ".join(held)] if fresh else []
        assert got.get(str(d), {}) == {i: hashlib.sha256(c.encode()).hexdigest() for i, c in enumerate(want)}


def test_selection_of_all_labels(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = {}
    for r in plans.QUERIES["mmr_summary"](spark, sf).collect():
        got.setdefault(r.label, {})[r.rank] = r.vec_id
    for label in {r.label for r in rows}:
        own = sorted((r.vec_id, np.array(r.embedding, float)) for r in rows if r.label == label)
        centre = np.mean([v for _, v in own], axis=0)
        cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
        pool = own if len(own) <= 100 else [own[round(i * (len(own) - 1) / 99)] for i in range(100)]
        left, chosen = dict(pool), []
        while left and len(chosen) < 12:
            score = {i: 0.6 * cos(v, centre) - 0.4 * max((cos(v, c) for _, c in chosen), default=0) for i, v in left.items()}
            best = max(score, key=lambda i: (round(score[i], 12), -i))
            chosen.append((best, left.pop(best)))
            left = {i: v for i, v in left.items() if cos(v, chosen[-1][1]) <= 0.85}
        assert got[label] == {k + 1: i for k, (i, _) in enumerate(chosen)}


def test_hashed_search_by_brute_force(spark, sf):
    from attesto.config import STOP_WORDS

    def vector(text):
        v = np.zeros(384)
        for w in re.findall(r"[^\W_]+", text.lower().replace("ß", "ss").replace("ё", "е")):
            if w not in STOP_WORDS:
                v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 384] += 1
        return v / (np.linalg.norm(v) or 1)

    docs = texts(spark, sf)
    ids, matrix = sorted(docs), np.array([vector(docs[i]) for i in sorted(docs)])
    got = {}
    for r in plans.QUERIES["hashed_topk"](spark, sf).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    for q in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        score = np.round(matrix @ vector(q.text), 6)
        best = sorted((i for i, s in zip(ids, score) if s > 0), key=lambda i: (-score[ids.index(i)], i))[:10]
        assert [(r, d) for r, d, _ in sorted(got[q.item_id])] == list(enumerate(best, 1))


def test_wrong_cells_of_all_tables(spark, sf):
    rows = {}
    for r in B.padded(B.tables(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")).collect():
        rows.setdefault((r.id, r.table), []).append((r.seq, r.cells))
    want = set()
    for (d, t), x in rows.items():
        x.sort()
        columns = list(zip(*(c for _, c in x)))
        key = next((i for i, c in enumerate(columns) if len(x) >= 2 and all(c) and len(set(c)) == len(c)), None)
        for i, c in enumerate(columns) if key is not None else ():
            if i != key:
                filled = [(seq, v) for (seq, _), v in zip(x, c) if v]
                for k, (seq, v) in enumerate(filled):
                    other = next((w for _, w in filled[k + 1 :] + filled[:k] if w != v), None)
                    want |= {(d, t, seq, i, v, other)} if other else set()
    got = {(r.doc_id, r.table, r.seq, r.column, r.value, r.wrong) for r in plans.QUERIES["table_stress"](spark, sf).collect()}
    assert got == want and len(want) > 100


def test_drafted_cases(spark, sf):
    docs, got = texts(spark, sf), plans.QUERIES["drafted_cases"](spark, sf).collect()
    assert len(got) > 5
    for r in got:
        assert r.answer not in r.question and "___" in r.question and r.question.replace("___", r.answer) in " ".join(docs[r.doc_id].split("\x00"))
    x = spark.createDataFrame([(r.doc_id, r.facts, docs[r.doc_id]) for r in got], "i long, f string, t string")
    assert x.where(~T.contains_fact("t", "f")).count() == 0


# Parser, pages, tables.


def test_headings_of_control_catalogues():
    e = P.parse("ZX-12\nLOCK AFTER USE\nwords\n(3) LOCK AFTER USE | BY REMOTE MEANS\nmore\nZX-13\nNOT in capitals\n")
    assert [(x.kind, x.level, x.text) for x in e[:1] + e[2:3]] == [("heading", 8, "ZX-12 LOCK AFTER USE"), ("heading", 9, "(3) LOCK AFTER USE | BY REMOTE MEANS")]
    assert e[3].path == ("ZX-12 LOCK AFTER USE", "(3) LOCK AFTER USE | BY REMOTE MEANS") and e[4].kind == "paragraph"


def test_captions_above_and_below():
    grid = "+---+---+\n| A | B |\n+===+===+\n| 1 | 2 |\n+---+---+"
    e = P.parse(f"{grid}\nTable 3: Below\n\ntext\nTable 4: Above\n{grid}\nTable 5: Next\n{grid}")
    assert [x.data.get("caption") for x in e if x.kind == "table"] == ["Table 3: Below", "Table 4: Above", "Table 5: Next"]
    e = P.parse("Таблица 7 Ряды\n| a | b |\n|---|---|\n| 1 | 2 |\n\nПродолжение Таблица 7 Ряды\n| a | b |\n|---|---|\n| 3 | 4 |\n\nОкончание Таблица 9 x\n| a | b |\n| 5 | 6 |")
    t = [x for x in e if x.kind == "table"]
    assert [x.data.get("continues") for x in t] == [None, e.index(t[0]), None] and t[1].data["title"] == "Таблица 7 Ряды"


def test_notes_in_linear_time():
    began = time.time()
    P.parse("\n".join(f"* bullet {i}" for i in range(4000)))
    e = P.parse("\n".join(f"[{i}] note {i}" for i in range(4000)) + "\nsee [17] and 42)")
    assert time.time() - began < 2 and e[-1].data["notes"] == ["[2] note 2", "[17] note 17", "[42] note 42"]


def test_a_callers_token_counter(spark):
    letters = lambda t: len(t.replace(" ", ""))
    body = "word " * 400
    for c in P.chunk(P.parse(body), "d", Chunking(100, 150, 10), letters):
        assert letters(c["text"]) == c["token_count"] <= 150
    docs = spark.createDataFrame([("d", body)], "k string, t string")
    assert P.chunks(docs, "k", "t", Chunking(100, 150, 10), count=letters).agg(F.max("token_count")).first()[0] <= 150


def test_pages_with_tables():
    page = "<h2>One <i>two</i>\nthree</h2><table><caption>Cap</caption><tr><th rowspan=2>ID<th colspan=2>G<tr><th>x<th>y<tr><td>1<td>a|b<td><table><tr><td>in</td></tr></table>side<tr><td rowspan=9>r<td colspan=2>w</table><p>end"
    assert html_text(page, tables=True) == "## One two three\n\nCap\n\n| ID | G / x | G / y |\n| --- | --- | --- |\n| 1 | a&#124;b | in side |\n| r | w | w |\n\nend\n"
    assert html_text("<div>" * 3000 + "x") == "x\n"


def test_word_files_with_spans_and_notes(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    head, down = "<w:trPr><w:tblHeader/></w:trPr>", '<w:vMerge w:val="restart"/>'
    table = f"<w:tbl><w:tr>{head}{cell('A', down)}{cell('G', '<w:gridSpan w:val=\"2\"/>')}</w:tr><w:tr>{head}{cell('', '<w:vMerge/>')}{cell('x')}{cell('y')}</w:tr><w:tr>{cell('1')}{cell('2')}{cell('3')}</w:tr></w:tbl>"
    body = f'<w:document {w}><w:body><w:p><w:r><w:t>Text</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>{table}</w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:id="2"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnote></w:footnotes>')
    assert files.docx_text(data.getvalue()) == "Text [^2]\n[^2]: Note\n| A | G / x | G / y |\n| --- | --- | --- |\n| 1 | 2 | 3 |"
    (tmp_path / "a.md").write_text("# My title\ntext")
    titles = files.document_titles(spark, f"file://{tmp_path}")
    assert [r.title for r in titles.collect()] == ["My title"]
    kept = titles.withColumn("title", F.lit("kept"))
    assert [r.title for r in files.document_titles(spark, f"file://{tmp_path}", kept).collect()] == ["kept"]


def test_text_rules(spark):
    assert one(spark, T.unwrap_single_column("t"), t="a\n| *Note:* one |\n| --- |\n| two |\nb\n| x | y |") == "a\nNote: one two\nb\n| x | y |"
    assert one(spark, T.clean_premise("t", exact=True), t="<p>caf&eacute;&#33;</p>") == "café!"
    assert one(spark, T.claim_anchors("t", enhancements=True), t="AB-7 (4) needs 12") == ["12", "ab-7(4)"]
    assert one(spark, T.tokenize("t", exact=True), t="ﬁsh Ⅷ STRAẞE") == ["fish", "viii", "strasse"]
    assert one(spark, T.evidence_windows(T.sentences("t")), t="A fox ran. It fell. Then rain. But no wind.") == ["A fox ran. It fell.", "Then rain. But no wind."]
    assert one(spark, T.sub_questions("t"), t="What is a lens and how is it made?") == ["What is a lens", "how is it made?"]
    assert one(spark, T.contains_fact("t", F.concat(F.lit("re:"), T.answer_pattern(F.lit("пять городов")))), t="всего там 5 больших городах")
    assert one(spark, X.title("t", F.lit("Own name")), t="First line\nx") == "First line: Own name"
    assert one(spark, B.header_groups("h"), h=["a", "b", "a", "b", "a", "b"]) == 3


# Claims.


def checked(spark, text, contexts, rules=Rules(), **more):  # noqa: B008
    answers = spark.createDataFrame([("a", text)], "key string, text string")
    kind = "key string, source_id string, text string, title string, section_path array<string>, document_id string"
    rows = C.verify(answers, spark.createDataFrame(contexts, kind), "key", "text", rules, **more).orderBy("ix").collect()
    return [(r.status, r.reason, r.grade) for r in rows]


def source(name, text, path=(), document="d", title=None):
    return ("a", name, text, title, list(path), document)


def test_reasons(spark):
    c = [source("S1", "The valve opens at 40 bar. Nothing else is said.")]
    got = checked(spark, "The valve opens at 40 bar [S1]. It opens at 41 bar [S1]. Wrong mark [S0]. Lost source [S7].\n[S1].", c)
    assert [x[:2] for x in got] == [("verified", None), ("unverified", "anchor_not_in_source"), ("unverified", "invalid_citation"), ("unverified", "unknown_citation"), ("unverified", "empty_claim")]


def test_anchors_may_stand_in_headings_rows_and_other_sources(spark):
    c = [source("S1", "The limit holds for all pumps.", ["4 Pumps of type P7"]), source("S2", "Codes:\n| a | b | c | d |\n| --- | --- | --- | --- |\n| 1 | 0 | 1 | 8 |")]
    model = lambda p, h: F.struct(F.lit(0.9).alias("e"), F.lit(0.1).alias("n"), F.lit(0.0).alias("c"))
    assert checked(spark, "The limit holds for P7 [S1].", c, nli=model)[0][0] == "verified"
    assert checked(spark, "The code of it is 101 [S2].", c, nli=model)[0][0] == "verified"
    assert checked(spark, "P7 has the code 101 [S1][S2].", c, nli=model)[0][0] == "verified"
    assert checked(spark, "P7 has the code 101 [S1].", c, nli=model)[0] == ("unverified", "anchor_not_in_source", "insufficient_evidence")
    other = [source("S1", "The control needs a lock."), source("S2", "See AB-7(4) for it."), source("S3", "See XY-9 there.", document="e")]
    wide = Rules(anchor_scope="document")
    assert checked(spark, "AB-7 (4) needs a lock [S1].", other, wide, nli=model)[0][0] == "verified"
    assert checked(spark, "AB-7 (4) needs a lock [S1].", other, nli=model)[0][1] == "anchor_not_in_source"
    assert checked(spark, "XY-9 needs a lock [S1].", other, wide, nli=model)[0][1] == checked(spark, "It needs 77 locks [S1].", other, wide, nli=model)[0][1] == "anchor_not_in_source"


def test_ways_of_support(spark):
    seen = lambda word, e, c: lambda p, h: F.when(F.contains(p, F.lit(word)) & (F.length(p) < 60), F.struct(F.lit(e).alias("e"), F.lit(0.0).alias("n"), F.lit(c).alias("c"))).otherwise(F.struct(F.lit(0.1).alias("e"), F.lit(0.6).alias("n"), F.lit(0.3).alias("c")))
    text = "Some words that come first and say little of use. The rate is 12 units. More words that follow after it, at length."
    claims = spark.createDataFrame([("a", "The rate is 12 units [S1].")], "key string, text string")
    kind = "key string, source_id string, text string, title string, section_path array<string>"

    def support(nli, text=text, title=None, claim=claims, rules=Rules()):  # noqa: B008
        c = C.inherit(C.claims(claim, "key", "text"), "key").withColumn("kind", C.kind("claim"))
        r = C.evidence(c, spark.createDataFrame([("a", "S1", text, title, ["5 Rates"])], kind), "key", nli, rules=rules).first()
        return r.support, r.e, r.c

    assert support(seen("rate is 12", 0.85, 0.01)) == ("window", 0.85, 0.01)
    assert support(seen("rate is 12", 0.5, 0.1)) == ("anchor_window", 0.5, 0.1)
    assert support(seen("Some words", 0.5, 0.1)) == (None, 0.1, 0.3)
    assert support(seen("Rates. The rate", 0.9, 0.0), title="Book") == ("window", 0.9, 0.0) and support(seen("Rates. The rate", 0.9, 0.0), title="Book", rules=Rules(titles=False))[0] is None
    rule = spark.createDataFrame([("a", "The rule is: max-age = delta-seconds [S1].")], "key string, text string")
    assert support(seen("never", 1.0, 0.0), "text then max-age=delta-seconds ends", claim=rule)[0] == "code_span"
    rows = "Table 2: Units\n| name | unit |\n| --- | --- |\n| flow | litre |\n| heat | joule |"
    flow = spark.createDataFrame([("a", "Flow is in litres [S1].")], "key string, text string")
    assert support(seen("name: flow; unit: litre", 0.9, 0.0), rows, claim=flow)[0] == "window" and support(seen("name: flow; unit: litre", 0.9, 0.0), rows, claim=flow, rules=Rules(table_rows=False))[0] is None


def test_judge_over_two_models(spark):
    model = lambda e, c: lambda p, h: F.struct(F.lit(e).alias("e"), F.lit(1 - e - c).alias("n"), F.lit(c).alias("c"))
    by_judge, c = Rules(decision="judge"), [source("S1", "The valve opens at 40 bar.")]
    assert checked(spark, "The valve opens at 40 bar [S1].", c, by_judge, nli=model(0.95, 0.0), second=model(0.95, 0.0))[0][2] == "supported"
    assert checked(spark, "The valve shuts [S1].", c, by_judge, nli=model(0.05, 0.95), second=model(0.05, 0.0))[0][2] == "contradicted"
    assert checked(spark, "The valve shuts [S1].", c, by_judge, nli=model(0.9, 0.0), second=model(0.05, 0.0), judged=Judge(threshold=0.99))[0][2] == "ambiguous"
    labels = C.labelled_nli(F.array(*map(F.lit, [0.2, 0.7, 0.1])), {1: "Entailment", 0: "contradiction", 2: "neutral"})
    assert tuple(one(spark, labels, a=1)) == (0.7, 0.1, 0.2)
    assert tuple(one(spark, C.labelled_nli(F.array(F.lit(0.25), F.lit(0.75)), {0: "not_entailment", 1: "entailment"}), a=1)) == (0.75, 0.25, 0.0)
    with pytest.raises(ValueError):
        C.labelled_nli(F.array(), {0: "LABEL_0", 1: "LABEL_1"})


def test_evidence_of_long_sources(spark):
    """Twice the sentences take about twice the time."""
    took = {}
    for n in (800, 3200, 6400):  # the first warms up
        text = " ".join(f"Sentence number {i} is about thing {i}." for i in range(n))
        began = time.time()
        assert checked(spark, f"Sentence number {n - 100} is about thing {n - 100} [S1].", [source("S1", text)])[0][0] == "verified"
        took[n] = time.time() - began
    assert took[6400] < 2.5 * took[3200] + 5


def test_values_in_lambdas_are_bound(spark):
    text = " ".join(f"Sentence {i} is long enough." for i in range(6400))
    df = spark.createDataFrame([(text,), (None,), ("",), ("One.",), ("One. Two.",)], "t string")
    got = [r.w for r in df.select(T.sentence_windows(T.sentences("t")).alias("w")).collect()]
    assert len(got[0]) == 6400 + 6399 and got[1] is None and got[2:] == [[], [], ["One.", "Two."]]


@pytest.mark.parametrize("text", ["1,234,567 and 12 345 678.5", "1234 567", "1 000 000 000 000 000 000 000 000 000 units", "1,2345 12,34", "v1.2 345", "0,001 9 999"])
def test_ungroup_has_no_limit(spark, text):
    want, before = text, None
    while want != before:
        before, want = want, re.sub(r"(?<![\d.,])(\d{1,3}(?:\d{3})*)[ ,\u00a0\u202f](?=\d{3}(?:[ ,\u00a0\u202f]\d{3})*(?!\d))", r"\1", want)
    assert one(spark, T.ungroup(F.lit(text)), a=1) == want


def test_deep_headings(spark):
    kind = "id int, seq int, level int, title string"
    x = spark.createDataFrame([(1, i, i, f"t{i}") for i in range(1, 13)] + [(1, 13, 11, "last"), (1, 14, None, None)], kind)
    paths = [r.section_path for r in P.with_section_path(x).orderBy("seq").collect()]
    assert paths[11] == [f"t{i}" for i in range(1, 13)] and paths[13] == [f"t{i}" for i in range(1, 11)] + ["last"]


FRESH = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from attesto.functions import text as T
from attesto.operators import claims as C
print(spark.createDataFrame([("e\u0301",)], "t string").select(T.composed(T._c("t")).alias("t")).first().t == "\u00e9")
a = spark.createDataFrame([("k", "The valve opens [S1].")], "key string, text string")
c = spark.createDataFrame([("k", "S1", "The valve opens.")], "key string, source_id string, text string")
print(C.verify(a, c, "key", "text").first().status)
"""


def test_workers_of_a_fresh_session(tmp_path):
    """Operators send the package to workers that don't have it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FRESH.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.stdout.split() == ["True", "verified"], done.stderr[-2000:]


def test_dossiers(spark):
    answers = spark.createDataFrame([("a", "It has 12 parts and 15 seals [S1].")], "key string, text string")
    contexts = spark.createDataFrame([("a", "S1", "It has 12 parts."), ("a", "S2", "And 15 seals.")], "key string, source_id string, text string")
    r = C.dossier(C.verify(answers, contexts, "key", "text"), contexts, "key").first()
    assert (r.anchors, r.missing, r.missing_everywhere) == (["12", "15"], ["15"], [])


# Search.


def test_plug_ins(spark):
    from attesto.config import Retrieval

    docs = spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "red whale")], "id long, text string")
    asked = spark.createDataFrame([(7, "red")], "q long, text string")
    encoder = lambda t: F.array(*(F.contains(t, F.lit(w)).cast("double") for w in ("red", "fox")), F.lit(0.1)).cast("array<float>")
    got = R.hybrid(docs, asked, "id", "q", "text", Retrieval(rerank_threshold=0.1), encoder=encoder, reranker=lambda q, d: F.length(d) / 100.0, dimension=3)
    assert {r.id: r.rerank for r in got.collect()} == {1: 0.07, 2: 0.1, 3: 0.09}
    part = R.hybrid(docs, asked, "id", "q", "text", Retrieval(), complete=spark.createDataFrame([(3,)], "id long"))
    assert [r.id for r in part.collect()] == [3]
    for bad in (dict(encoder=encoder, dimension=4), dict(encoder=lambda t: F.array(F.lit(float("nan")), F.lit(1.0)), dimension=2), dict(reranker=lambda q, d: F.lit(1.5))):
        with pytest.raises(Exception, match="must give"):
            R.hybrid(docs, asked, "id", "q", "text", Retrieval(), **bad).collect()


def test_fusion_checks_its_rankings(spark):
    kind = "query int, id string, rank int"
    twice = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], kind)
    with pytest.raises(Exception, match="an id twice"):
        R.fuse({"x": (twice, 1.0)}).collect()
    with pytest.raises(ValueError):
        R.fuse({"x": (twice, float("nan"))})
    with pytest.raises(Exception, match="no finite number"):
        R.fuse({"x": (twice.limit(1), spark.createDataFrame([(1, float("nan"))], "query int, weight double"))}).collect()


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    got = R.nearest(v, v.where("vec_id < 10"), 3).collect()
    monkeypatch.undo()
    assert sorted(got) == sorted(R.nearest(v, v.where("vec_id < 10"), 3).collect()) and len(got) == 30
    monkeypatch.setattr(R, "QUOTE_BLOCK", 4)
    docs, quotes = spark.createDataFrame([(1, "a bb ccc"), (2, "bb")], "id long, t string"), spark.createDataFrame([(1, "BB"), (2, "ccc"), (3, "a  bb"), (4, ""), (5, "zz")], "q long, t string")
    assert sorted(map(tuple, R.containing(docs, quotes, "id", "q", "t").collect())) == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_graded_and_unit_metrics(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "p", 2), (1, "p", 3), (1, "q", 4)], "query int, id string, rank int")
    r = R.graded_metrics(ranked, spark.createDataFrame([(1, "p", 2), (1, "q", 1)], "query int, id string, grade int"), 3).first()
    assert (r.hit, r.mrr) == (1.0, 0.5) and r.ndcg == pytest.approx((3 / np.log2(3) + 1 / 2) / (3 + 1 / np.log2(3)), abs=1e-6)
    # One place serves one unit: the chunk that both units name counts for the first, the second waits for its own.
    ranked = spark.createDataFrame([(1, "both", 1), (1, "own", 3)], "query int, id string, rank int")
    r = R.unit_metrics(ranked, spark.createDataFrame([(1, 0, ["both"]), (1, 1, ["both", "own"])], "query int, unit int, ids array<string>")).first()
    assert (r.recall_1, r.ndcg_1) == (1.0, 1.0) and r.ndcg_3 == pytest.approx((1 + 1 / np.log2(3)) / (1 + 1 / np.log2(3)), abs=1e-6)
    r = R.unit_metrics(ranked, spark.createDataFrame([(1, 0, ["both"]), (1, 1, ["both"])], "query int, unit int, ids array<string>")).first()
    assert r.ndcg_3 == pytest.approx(1 / (1 + 1 / np.log2(3)), abs=1e-6)


# Orders, samples, runs.


def test_orders_in_ranges(spark):
    x = spark.createDataFrame([(g, float((i * 37) % 101), i) for g in "ab" for i in range(101)], "g string, s double, c int")
    want = sorted(map(tuple, E.below(x, "s", ["c"], "g").collect()))
    assert sorted(map(tuple, E.below(x, "s", ["c"], "g", most=20).collect())) == want
    assert all(b == sum((i for i in range(101) if (i * 37) % 101 < s)) for _, s, _, b in want)


def test_next_of_another_kind_in_ranges(spark):
    import random

    r = random.Random(4)
    rows = [(i * 3 + r.randint(0, 2), r.choice("xxxy" if i < 60 else "z"), r.choice("ab")) for i in range(90)]
    got = {x.k: x.other for x in N.next_of_other(spark.createDataFrame(rows, "k long, s string, g string"), "k", "s", "g", most=7).collect()}
    want = {}
    for k, s, g in rows:
        later = sorted((o, t) for o, t, h in rows if h == g and t != s)
        if later:
            want[k] = next((o for o, _ in later if o > k), later[0][0])
    assert got == want


def test_bootstrap(spark):
    rows = [(i, i % 10 < 6, i % 10 < 5) for i in range(2000)]
    r = E.bootstrap_difference(spark.createDataFrame(rows, "k long, x boolean, y boolean"), "k", "x", "y", 300).first()
    half = 196 * np.sqrt(0.09 / 2000)
    assert r.points == 10 and r.low == pytest.approx(10 - half, abs=0.4) and r.high == pytest.approx(10 + half, abs=0.4)


def test_curves_and_regression(spark):
    rows = [(1 / (1 + np.exp(-3 * (i - 100) / 30)), (i * 7919 % 200) < i) for i in range(200)]
    x = spark.createDataFrame([(float(p), bool(y)) for p, y in rows], "p double, y boolean")
    loss = lambda c: E.calibration(X_.select(F.col(c).alias("p"), "y"), "p", F.col("y")).first()["log_loss"]
    for how in ("temperature", "platt"):
        X_ = E.fitted_curve(x, "p", "y", how)
        assert loss("calibrated") < loss("p") - 0.05
    with pytest.raises(ValueError):
        E.fitted_curve(x, "p", "y", "other")


def test_replay(spark):
    kind = "k string, i int, role string, refused boolean, reason string, claims int"
    no, none = "nli_verification_failed", None
    rows = [("mended", 0, "draft", True, no, 2), ("mended", 1, "repair", True, no, 1), ("mended", 2, "repair", False, none, 1)]
    rows += [("thought", 0, "draft", True, "llm_refusal", 0), ("thought", 1, "think", False, none, 3), ("short", 0, "draft", True, no, 2)]
    rows += [("drawn", 0, "draft", True, "llm_refusal", 0), ("drawn", 1, "think", True, "llm_refusal", 0), ("drawn", 2, "recovery", True, "llm_refusal", 0), ("drawn", 3, "recovery", False, none, 1), ("fine", 0, "draft", False, none, 1)]
    cases = spark.createDataFrame([("drawn", 0.9), ("thought", 0.9)], "k string, best double")
    got = {r.k: (r.path, r.final, r.reason, r.missing) for r in N.replay(spark.createDataFrame(rows, kind), cases, "k", "i").collect()}
    assert got["mended"] == (["draft", "repair", "repair"], 2, none, none) and got["thought"] == (["draft", "think"], 1, none, none)
    assert got["drawn"] == (["draft", "think", "recovery", "recovery"], 3, none, none) and got["fine"] == (["draft"], 0, none, none)
    assert got["short"][3] == "repair" and got["short"][2] == no


def test_summaries(spark):
    items = spark.createDataFrame([("a", i, f"t{i}") for i in range(9)] + [("b", 0, "only")], "g string, o int, t string")
    made = {r.g: r.text for r in M.map_reduce(items, "g", "o", "t", lambda t: F.length(t), lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)), 4).collect()}
    assert made.keys() == {"a", "b"} and made["b"] == "oy" and len(made["a"]) == 2
    with pytest.raises(Exception, match="used up"):
        M.map_reduce(items, "g", "o", "t", lambda t: F.length(t), lambda t: F.substring(t, 1, 2), 4, calls=3)
    with pytest.raises(Exception, match="exceeds the budget"):
        M.batches_of(items.withColumn("n", F.lit(9)), "g", "o", "n", 4).collect()
    v = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [1.0, 0.01]), ("g", 2, [0.0, 1.0])], "g string, i int, v array<double>")
    assert sorted(r.i for r in M.distinct_by_group(v, "i", "v", "g", "i").collect()) == [0, 2]
    claims = v.select("g", "i", F.col("v").alias("vector"), F.array(F.lit("S1")).alias("source_ids"))
    windows = spark.createDataFrame([("g", "S1", 0, [1.0, 0.0], 0.1), ("g", "S1", 1, [0.0, 1.0], 0.9), ("g", "S2", 2, [0.0, 1.0], 0.0)], "g string, source_id string, w int, vector array<double>, c double")
    assert [r.status for r in M.summary_claims(claims, windows, "g", "i").orderBy("i").collect()] == ["accepted", "duplicate", "contradiction"]


# Stores and sinks.


def test_chunk_store(spark, tmp_path):
    encode = lambda t: F.array(F.length(t).cast("float"), F.lit(1.0).cast("float"))
    s = store.ChunkStore(spark, f"file://{tmp_path}/s", encode, "len", 2)
    kind = "chunk_id string, document_id string, source string, ordinal int, expected int, text string, section_path array<string>"
    rows = lambda *r: spark.createDataFrame([(c, d, "F", o, n, t, ["A"]) for c, d, o, n, t in r], kind)
    assert s.read().count() == 0 and s.add(rows(("1", "d", 0, 2, "x"), ("2", "d", 1, 2, "y"), ("3", "e", 0, 2, "z"))) == 3
    assert [r.document_id for r in s.catalogue().collect()] == ["d"] and "vector" not in s.read().columns
    with pytest.raises(ValueError, match="twice"):
        s.add(rows(("9", "f", 0, 1, "x"), ("9", "f", 0, 1, "x")))
    with pytest.raises(Exception, match="must give"):
        store.ChunkStore(spark, f"file://{tmp_path}/t", encode, "len", 3).add(rows(("1", "d", 0, 1, "x")))
    s.add(rows(("4", "d", 0, 1, "new")))
    assert {r.chunk_id for r in s.read().collect()} == {"3", "4"} and s.delete(spark.createDataFrame([("e",)], "document_id string")) == 1
    assert [(r.chunk_id, r.point_id) for r in s.read().collect()] == [("4", str(uuid.uuid5(uuid.NAMESPACE_URL, "4")))]
    other = store.ChunkStore(spark, f"file://{tmp_path}/s", encode, "another", 2)
    with pytest.raises(store.SignatureChanged):
        other.check()


def test_sinks(spark, tmp_path):
    path = store.land(spark, f"file://{tmp_path}/in", "../a b?.md", b"# T")
    assert path.endswith("/a b_.md") and store.land(spark, f"file://{tmp_path}/in", "other.md", b"# T").endswith("/other.md")
    assert [r.text for r in files.read_documents(spark, f"file://{tmp_path}/in").collect()] == ["# T"]
    for bad in (b"", b"x" * (store.LARGEST_UPLOAD + 1)):
        with pytest.raises(ValueError):
            store.land(spark, f"file://{tmp_path}/in", "x.md", bad)
    rows = spark.createDataFrame([("a|b", 0.5), (None, 2.0)], "n string, v double")
    assert store.markdown_report(rows) == "| n | v |\n| --- | --- |\n| a\\|b | 0.5 |\n|  | 2 |"
    with pytest.raises(ValueError):
        store.markdown_report(rows, 1)
    store.write_summary(rows, f"file://{tmp_path}/s", "csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/s").count() == 2


def test_no_local_folder_on_a_cluster(monkeypatch):
    from attesto import storage

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)  # noqa: N815

        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


def test_workspace(spark):
    ws = Workspace(spark, "t")
    kept = ws.save(spark.range(3), "x")
    assert kept.count() == 3
    ws.drop("x")
    with pytest.raises(Exception, match="x"):
        spark.read.parquet(f"{ws.path}/x")
