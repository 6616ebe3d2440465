"""Queries against their SQL over small tables with what larger ones hold: copies, cut references, blanks."""

from __future__ import annotations

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


def both(spark, sf, name):
    con = duckdb.connect()
    for t in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    df = entry.queries()[name](spark, str(sf))
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = Counter(repr([r[names.index(c)] for c in df.columns]) for r in found.fetchall())
    return Counter(repr(list(r)) for r in df.collect()), want


@pytest.mark.parametrize("name", ["page_sections", "html_markdown", "html_text"])
def test_references_without_end(spark, tmp_path, name):
    html = ["<html><body><p>of&amp; on&amp</p><h1>of&amp</h1>\n<p>x &copy y &amp;</p></body></html>", "<div>on## of### que,*** </div><p>a # b </p><h1> c </h1><p>d </p>"]
    pq.write_table(pa.table({"page_id": [1, 2], "url": ["u"] * 2, "html": html}), tmp_path / "pages.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and want


@pytest.mark.parametrize("name", ["distinct_vectors", "summary_claims"])
def test_vectors_that_are_copies(spark, tmp_path, name):
    vectors = [[(1.0 if i == (k // 6) else 0.2 * ((i * 7 + k // 6) % 3)) for i in range(64)] for k in range(24)]
    columns = {"vec_id": pa.array(range(24)), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([k // 12 for k in range(24)], pa.int32())}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    got, want = both(spark, tmp_path, name)
    assert got == want and want


def test_files_of_rows_without_ids_or_texts(spark, tmp_path):
    docs = {"doc_id": pa.array([1, 2, 2, None, None, 3, 4], pa.int64()), "text": ["a", "b", "b", "c", None, None, ""]}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    got, want = both(spark, tmp_path, "corpus_files")
    assert got == want and len(want) == 6


def test_all_vectors_are_asked_for(spark, tmp_path):
    vectors = [[float((i * 7 + k * k) % 11 - 5) for i in range(8)] for k in range(120)] + [[1.0] * 8] * 20
    columns = {"vec_id": pa.array(range(1, 141)), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([k % 3 for k in range(140)], pa.int32())}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    got, want = both(spark, tmp_path, "label_knn_vote")
    assert got == want and len(want) == 140


def test_abbreviations_beside_letters_that_arent_ascii(spark, tmp_path):
    """The SQL's word boundaries know ASCII only."""
    texts = ["Mua ở Mèch. Viêt kể. Xong.", "Bài èch. VI hết. Xong", "See ch. VI there. Ended.", "Das ép. 5 war. Ja.", "На стр. 5 есть. Да.", "xрис. 5 z. Да", "öv. 2 und vs. Ja. ünos. 3 da", "the etc. and öetc. so. A"]
    turns = {"conv_id": list(range(len(texts))), "turn": [1] * len(texts), "role": ["assistant"] * len(texts), "text": texts}
    pq.write_table(pa.table(turns), tmp_path / "conversations.parquet")
    got, want = both(spark, tmp_path, "claim_segments")
    assert got == want and want


def test_near_copies_shuffle_first_words_only(spark, tmp_path):
    """Words are written once; of these, the join has the first of each set of copies."""
    texts = [" ".join(f"w{(k // 4) * 50 + i}" for i in range(20)) + (" more" if k % 4 == 3 else "") for k in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["near_duplicate_docs"](spark, str(tmp_path))
    want = Counter((a, b, 1.0 if b % 4 < 3 else round(20 / 21, 6)) for a in range(40) for b in range(a + 1, 40) if a // 4 == b // 4)
    assert Counter(tuple(r) for r in df.collect()) == want
    prefixes = [f for f in df.inputFiles() if "/pairs/" in f]
    assert prefixes and spark.read.parquet(prefixes[0].split("/pairs/")[0] + "/prefixes").count() == 20 * 12


def test_sets_that_are_far_apart_drop_out_by_their_signatures(spark, tmp_path):
    """Documents that share their rare words and not the rest aren't a pair that is shuffled."""
    texts = [" ".join([*(f"rare{i}" for i in range(12)), *(f"d{k}w{i}" for i in range(40))] * (1 + k % 2)) for k in range(6)] + ["d0w1 " + " ".join(f"c{i}" for i in range(300))] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["near_duplicate_docs"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [(6, 7, 1.0)]
    where = next(f for f in df.inputFiles() if "/pairs/" in f).split("/pairs/")[0]
    x = spark.read.parquet(where + "/prefixes")
    signs = [c for c in x.columns if c[0] == "s"]
    rows = {r.doc_id: r for r in x.dropDuplicates(["doc_id"]).collect()}
    differ = lambda a, b: sum((rows[a][c] ^ rows[b][c]).bit_count() if rows[a][c] ^ rows[b][c] >= 0 else 64 - (~(rows[a][c] ^ rows[b][c])).bit_count() for c in signs)
    assert signs and all(9 * differ(a, b) > rows[a].n + rows[b].n for a in range(6) for b in range(a))


def test_memory_of_batches_is_given_back(monkeypatch):
    """A worker outlives its tasks: what Arrow's pool keeps is released at the end of each."""
    from attesto.llm import workspace

    released = []
    monkeypatch.setattr(workspace.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: released.append(1)})())
    batches = [pa.RecordBatch.from_arrays([pa.array(["x"] * 700)], names=["t"])] * 2
    assert sum(b.num_rows for b in workspace.slices(iter(batches))) == 1400 and released == [1]


def test_sessions_of_a_stream_stay_out_of_the_driver(spark, sf):
    """The result is a table of files, not of a memory sink."""
    got = entry.queries()["stream_user_sessions"](spark, sf)
    assert got.inputFiles()
