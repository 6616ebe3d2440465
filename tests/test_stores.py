"""Tables that change by commits, what is derived from them, caches and sinks."""

from __future__ import annotations

import os
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesto.operators import retrieval as R
from attesto.sources import store
from attesto.sources.corpus_sink import CorpusWriter, Written
from attesto.sources.derived import LexicalIndex
from attesto.sources.keyed import Conflict, KeyedTable

KIND = "k string, m string, v int"


def table(spark, tmp_path, **more):
    return KeyedTable(spark, f"file://{tmp_path}/t", KIND, "k", "m", **{"buckets": 4, **more})


def rows(spark, *r, kind=KIND):
    return spark.createDataFrame(list(r), kind).coalesce(2)


def seen(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyed_table(spark, tmp_path):
    t = table(spark, tmp_path)
    assert seen(t.read()) == [] and t.version().number == 0
    t.put(rows(spark, ("a", "1", 1), ("a", "2", 2), ("b", "1", 3), (None, "x", 4)))
    first = t.version()
    t.put(rows(spark, ("a", "9", 9)))
    assert seen(t.read()) == [("a", "9", 9), ("b", "1", 3), (None, "x", 4)]
    assert seen(t.read(first)) == [("a", "1", 1), ("a", "2", 2), ("b", "1", 3), (None, "x", 4)]
    t.delete(spark.createDataFrame([(None,)], "k string"))
    t.change(rows(spark, ("b", "1", 5), ("b", "2", 6)), spark.createDataFrame([("b", "1")], "k string, m string"))
    assert seen(t.read()) == [("a", "9", 9), ("b", "1", 5), ("b", "2", 6)]
    assert seen(t.lookup(spark.createDataFrame([("b",), ("z",)], "k string"))) == [("b", "1", 5), ("b", "2", 6)]
    before = t.version()
    t.merge(0)
    assert t.version().gone == 0 and seen(t.read()) == seen(t.read(before)) and not any(f.gone for f in t.version().files)
    assert [seen(x) for x in t.changes(before)] == [[], []]
    came, went = t.changes(first)
    assert seen(came) == [("a", "9", 9), ("b", "1", 5), ("b", "2", 6)] and seen(went) == [("a", "1", 1), ("a", "2", 2), ("b", "1", 3), (None, "x", 4)]
    with pytest.raises(ValueError, match="buckets"):
        table(spark, tmp_path, buckets=8).read()


def test_expiry(spark, tmp_path):
    t = table(spark, tmp_path)
    for i in range(4):
        t.put(rows(spark, ("a", "1", i)))
    parquet = lambda: {f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    t.merge(0)
    held = len(parquet())
    t.expire()  # files that may be another writer's stay
    assert len(parquet()) == held and t._numbers() == [5]
    t.expire(age=-1)
    assert parquet() == {f.name.rpartition("/")[2] for f in t.version().files} and seen(t.read()) == [("a", "1", 3)]


def test_a_lost_writer_and_a_failed_one(spark, tmp_path):
    t = table(spark, tmp_path)
    base = t.version()
    t.put(rows(spark, ("a", "1", 1)))
    with pytest.raises(Conflict):
        t.change(rows(spark, ("b", "1", 1)), base=base)
    with pytest.raises(Exception, match="no number"):
        t.put(rows(spark, ("c", "1", 1)).withColumn("v", F.raise_error(F.lit("no number")).cast("int")))
    t.expire(age=-1)
    assert seen(t.read()) == [("a", "1", 1)] and len([f for _, _, fs in os.walk(f"{tmp_path}/t/data") for f in fs if f.endswith(".parquet")]) == 1


def test_random_changes(spark, tmp_path):
    """Against a dictionary, with merges in between."""
    r, held, t = random.Random(1), {}, table(spark, tmp_path, buckets=3)
    for step in range(8):
        keys = [f"k{r.randint(0, 9)}" for _ in range(4)]
        if r.random() < 0.3 and held:
            t.delete(spark.createDataFrame([(k,) for k in keys], "k string"))
            held = {k: v for k, v in held.items() if k not in keys}
        else:
            new = {k: [(k, str(m), r.randint(0, 9)) for m in range(r.randint(1, 3))] for k in keys}
            t.put(rows(spark, *(x for v in new.values() for x in v)))
            held |= new
        if step % 3 == 2:
            t.merge(2)
        assert seen(t.read()) == sorted((x for v in held.values() for x in v), key=repr)


def chunks(spark, *r):
    kind = "chunk_id string, document_id string, source string, ordinal int, expected int, text string, section_path array<string>"
    return spark.createDataFrame([(c, d, "F", 0, 1, t, ["A"]) for c, d, t in r], kind)


def chunk_store(spark, path, **more):
    encode = lambda t: F.array(F.length(t).cast("float"), F.lit(1.0).cast("float"))
    return store.ChunkStore(spark, f"file://{path}", encode, "len", 2, **more)


def test_two_writers_are_both_kept(spark, tmp_path):
    s = chunk_store(spark, tmp_path / "s")
    s.add(chunks(spark, ("c0", "d0", "x")))
    errors = []

    def write(i):
        try:
            chunk_store(spark, tmp_path / "s").add(chunks(spark, (f"c{i}", f"d{i}", "y"), (f"e{i}", f"d{i}", "z")))
        except Exception as error:  # shown by the assertion
            errors.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and {r.chunk_id for r in s.read().collect()} == {"c0", "c1", "c2", "c3", "e1", "e2", "e3"} and s.version() == 4


def test_an_id_that_moves(spark, tmp_path):
    s = chunk_store(spark, tmp_path / "s")
    s.add(chunks(spark, ("1", "d", "x"), ("2", "d", "y"), ("3", "e", "z")))
    s.add(chunks(spark, ("2", "f", "moved")))
    assert sorted((r.chunk_id, r.document_id, r.text) for r in s.read().collect()) == [("1", "d", "x"), ("2", "f", "moved"), ("3", "e", "z")]


def test_a_small_change_writes_little(spark, tmp_path):
    s = chunk_store(spark, tmp_path / "s", buckets=16)
    text = lambda i: f"{random.Random(i).random()} " * 200
    s.add(chunks(spark, *((f"c{i}", f"d{i}", text(i)) for i in range(1000))))
    whole = sum(f.bytes for f in s.table.version().files)
    before = {f.name for f in s.table.version().files}
    s.add(chunks(spark, *((f"c{i}", f"d{i}", text(-i)) for i in range(10))))
    new = [f for f in s.table.version().files if f.name not in before]
    assert before <= {f.name for f in s.table.version().files} and sum(f.bytes for f in new) < whole / 5 and s.read().count() == 1000
    worn = {f.bucket for f in new}
    s.table.merge(2)  # a bucket that changed has its rows, new ones, and a list of what goes
    now = s.table.version().files
    assert {f.bucket for f in now if f.name not in before} == worn and {f.name for f in now if f.bucket not in worn} < before
    assert s.read().count() == 1000 and s.table.version().gone == 0


def test_index_follows_its_source(spark, tmp_path):
    """After random changes, the same tables as built anew."""
    r, words = random.Random(2), "alpha beta gamma delta epsilon zeta Straße мир 12".split()
    source = KeyedTable(spark, f"file://{tmp_path}/d", "id long, text string", "id", buckets=4)
    index = LexicalIndex(spark, f"file://{tmp_path}/i", source, "id", "text", buckets=4)
    for step in range(4):
        ids = r.sample(range(30), 8)
        if step % 2:
            source.delete(spark.createDataFrame([(i,) for i in ids], "id long"))
            source.merge(1)
        source.put(spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in ids[:5]], "id long, text string"))
        assert index.refresh() == source.version().number and index.refresh() == source.version().number
        docs = source.read()
        want, got = R.build_index(docs, "id", "text"), index.index()
        plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.collect())
        assert plain(got.postings.select("id", "term", "tf", "dl")) == plain(want.postings.select("id", "term", "tf", "dl"))
        assert plain(got.terms) == plain(want.terms) and plain(got.corpus) == plain(want.corpus)
    for t in (index.postings, index.terms):
        t.merge(1)
    asked = spark.createDataFrame([(1, "alpha мир"), (2, "nothing")], "q long, text string")
    terms = R.query_terms(asked, "q", "text")
    few = index.index(terms=terms.select("term"))
    assert plain(R.bm25(few, terms, 5)) == plain(R.bm25(R.build_index(docs, "id", "text"), terms, 5)) != []
    index.rebuild()
    assert plain(index.index().postings.select("id", "term", "tf", "dl")) == plain(want.postings.select("id", "term", "tf", "dl"))


def test_postings_of_a_change_are_made_once(spark, tmp_path, monkeypatch):
    """Both tables of an index follow from the same blocks, written once for what came and once for what went."""
    from attesto.operators import postings as P

    made, blocks = [], P.blocks
    monkeypatch.setattr(P, "blocks", lambda *a, **k: made.append(1) or blocks(*a, **k))
    source = KeyedTable(spark, f"file://{tmp_path}/d", "id long, text string", "id", buckets=2)
    index = LexicalIndex(spark, f"file://{tmp_path}/i", source, "id", "text", buckets=2)
    source.put(spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta"), (3, None)], "id long, text string"))
    index.refresh()
    source.put(spark.createDataFrame([(1, "gamma")], "id long, text string"))
    index.refresh()
    assert len(made) == 4
    assert sorted(map(tuple, index.terms.read().collect())) == [("beta", 1, 1), ("gamma", 1, 1)] and index.terms.version().state["documents"] == 3


def test_scores_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a, b):
        calls.add(1)
        return float(len(a or "") - len(b or ""))

    kind, path = "p string, h string", f"file://{tmp_path}/scores"
    pairs = rows(spark, ("a", "bb"), ("a", "bb"), ("c", "d"), (None, "d"), ("e", None), kind=kind)
    got = store.scored_once(pairs, path, score("p", "h"), "p", "h")
    made = calls.value
    assert sorted((r.h, r.score) for r in got.collect() if r.p in ("a", "c")) == [("bb", -1.0), ("bb", -1.0), ("d", 0.0)]
    assert got.count() == 5 and made == len({r.key for r in got.collect()}) and calls.value == made  # reading scores nothing
    again = store.scored_once(rows(spark, ("c", "d"), ("new", "x"), kind=kind), path, score("p", "h"), "p", "h")
    assert sorted((r.p, r.score) for r in again.collect()) == [("c", 0.0), ("new", 2.0)] and calls.value == made + 1


def test_parsed_once_by_two_runs(spark, tmp_path):
    from attesto.config import Chunking

    docs = rows(spark, (1, "a b"), (2, "c d e"), (3, "a b"), kind="id long, text string").withColumn("digest", F.sha2("text", 256))
    parse = lambda d: d.select("key", F.explode(F.split("text", " ")).alias("w"))
    done = []
    threads = [threading.Thread(target=lambda: done.append(store.parsed_once(docs, f"file://{tmp_path}/c", parse, "digest", Chunking()))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [sorted(r.w for r in x.collect()) for x in done] == [list("abcde")] * 3


def test_corpus_of_files(spark, tmp_path):
    kind, path = "n string, text string", f"{tmp_path}/corpus"
    found = lambda: Counter((f, open(os.path.join(d, f), encoding="utf-8", newline="").read()) for d, _, fs in os.walk(path) for f in fs if not f.startswith("."))
    store.write_corpus(rows(spark, ("a", "x\r\ny"), ("b", None), ("é", "日本"), kind=kind), f"file://{path}", "n", "text")
    assert found() == {("a.md", "x\r\ny"): 1, ("b.md", ""): 1, ("é.md", "日本"): 1}
    with pytest.raises(store.NameClash):
        store.write_corpus(rows(spark, ("a/x", "1"), ("b/x", "2"), kind=kind), f"file://{path}", "n", "text")
    assert len(found()) == 3  # nothing was written
    store.write_corpus(rows(spark, ("c", "z"), kind=kind), f"file://{path}", "n", "text")
    assert found() == {("c.md", "z"): 1}
    with pytest.raises(Exception, match="odd text"):
        store.write_corpus(rows(spark, ("d", "z"), kind=kind).withColumn("text", F.raise_error(F.lit("odd text"))), f"file://{path}", "n", "text")
    assert found() == {("c.md", "z"): 1}


def test_corpus_attempts(tmp_path):
    """What an attempt left that doesn't count is removed; an aborted job leaves nothing."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["a"], "text": ["x"]})
    writer = CorpusWriter(f"file://{tmp_path}/c", True)
    lost, good = writer.write(iter([batch])), writer.write(iter([batch]))
    assert isinstance(lost, Written)
    writer.commit([good, None])
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs] == ["a.md"]
    failed = CorpusWriter(f"file://{tmp_path}/c", True)
    failed.write(iter([batch]))
    failed.abort([None])
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs] == ["a.md"]


def test_ledger_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that fails after it wrote is done again: exactly once in effect.  The state knows what the ledger had."""
    from attesto.streaming import ingest

    kind, src, out = "doc_id long, text string", f"file://{tmp_path}/in", f"file://{tmp_path}/ledger"

    def run():
        q = ingest.ingest_stream(spark.readStream.schema(kind).parquet(src), out, f"file://{tmp_path}/c")
        q.awaitTermination()
        return q.lastProgress

    spark.createDataFrame([(5, "a"), (2, "b"), (3, "a"), (None, "n"), (9, None)], kind).repartition(3).write.parquet(src)
    assert run()["stateOperators"][0]["numRowsTotal"] >= 4
    spark.createDataFrame([(i, "a") for i in range(100, 300)] + [(8, "c"), (7, ""), (1, "b")], kind).repartition(4).write.mode("append").parquet(src)
    whole = ingest.write_batch

    def dies(rows, number, path):
        whole(rows, number, path)
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(ingest, "write_batch", dies)
    with pytest.raises(Exception, match="the driver is lost"):
        run()
    monkeypatch.setattr(ingest, "write_batch", whole)
    progress = run()
    assert progress["stateOperators"][0]["numRowsTotal"] == 5
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 208 and sorted(r.doc_id for r in rows if r.status == "added" and r.doc_id) == [2, 3, 8, 9]
    assert Counter(r.status for r in rows if r.batch == 1) == {"duplicate": 202, "added": 1}
    assert [r.batch for r in ingest.commit_report(spark.read.parquet(out)).collect()] == [0, 1]


def test_state_of_contents_is_no_call_of_python(spark, tmp_path):
    """Contents are looked up in the state by Spark itself; repeats of an id with its content are added once."""
    from attesto.streaming import ingest

    kind, src, out = "doc_id long, text string", f"file://{tmp_path}/in", f"file://{tmp_path}/ledger"
    spark.createDataFrame([(2, "a"), (2, "a"), (None, "b"), (7, "b"), (None, "c")], kind).repartition(2).write.parquet(src)
    q = ingest.ingest_stream(spark.readStream.schema(kind).parquet(src), out, f"file://{tmp_path}/c")
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["operatorName"] == "dedupe"
    rows = spark.read.parquet(out).collect()
    assert Counter((r.doc_id, r.status) for r in rows) == {(2, "added"): 1, (2, "duplicate"): 1, (7, "added"): 1, (None, "duplicate"): 1, (None, "added"): 1}


def test_models_can_be_fitted_after_a_change(spark, tmp_path):
    """A change leaves nothing in the session that other work stumbles over."""
    from attesto.operators import evaluate as E

    table(spark, tmp_path).put(rows(spark, ("a", "1", 1)))
    x = spark.createDataFrame([(i / 40, i * 7 % 40 < i) for i in range(1, 40)], "p double, y boolean")
    assert E.fitted_curve(x, "p", "y", "platt").count() == 39
