"""Blocks of postings against scores in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attesto.operators import postings as P
from attesto.operators import retrieval as R
from attesto.storage import Workspace

K1, B = 1.5, 0.75


def plain(docs, queries, k):
    """{query: [(rank, id, score)]} by the definition."""
    tf = {i: Counter(words) for i, words in docs.items()}
    n, df = len(docs), Counter(t for c in tf.values() for t in c)
    avgdl = sum(map(len, docs.values())) / n
    idf0 = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(idf0.values()) / len(idf0)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in idf0.items()}
    out = {}
    for q, words in queries.items():
        asked = Counter(w for w in words if w in df)
        score = {}
        for i, c in tf.items():
            if any(t in c for t in asked):
                score[i] = round(sum(m * idf[t] * c[t] * (K1 + 1) / (c[t] + K1 * (1 - B + B * len(docs[i]) / avgdl)) for t, m in asked.items() if t in c), 6)
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        if best:
            out[q] = [(r, i, s) for r, (i, s) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_of_blocks(spark, seed):
    """Ties, repeated terms, common terms of negative weight, terms that nothing has."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["common"] * 30
    docs = {i: [r.choice(words) for _ in range(r.choice([0, 3, 5, 40]))] for i in range(300)}
    queries = {q: [r.choice([*words[:14], "nothing"]) for _ in range(r.randint(1, 6))] for q in range(40)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(1000, None)], "id long, t string").repartition(5)
    index = R.write_index(d, "id", "t", Workspace(spark, "blocks"))
    asked = R.query_terms(spark.createDataFrame([(q, " ".join(w)) for q, w in queries.items()], "q long, t string"), "q", "t")
    want = plain({**docs, 1000: []}, queries, 7)
    got = {}
    for x in R.bm25(index, asked, 7).collect():
        got.setdefault(x.query, []).append((x.rank, x.id, round(x.score, 6)))
    assert {q: sorted(x) for q, x in got.items()} == want
    assert R.bm25(index, asked.limit(0), 7).count() == 0
    rows = {(x.id, x.term): (x.tf, x.dl) for x in index.postings.collect()}
    assert rows == {(i, t): (n, len(w)) for i, w in docs.items() for t, n in Counter(w).items()}


def run(docs, k, weights, cut):
    """Blocks of few tokens, searched by one task."""
    ids = pa.array(list(docs), pa.string())
    lists = pa.array([docs[i] for i in docs], pa.list_(pa.string()))
    made = list(P._blocks(iter([pa.RecordBatch.from_arrays([ids, lists], names=["id", "tokens"]).slice(0, len(docs) // 2), pa.RecordBatch.from_arrays([ids, lists], names=["id", "tokens"]).slice(len(docs) // 2)])))
    assert sum(len(b.column(0)[0].values) for b in made) == len(docs) and (not cut or len(made) > 3)
    terms = sorted(weights)
    hits = P._search(iter(made), ["q"], pa.array(terms), np.zeros(len(terms), int), np.arange(len(terms)), np.array([weights[t] for t in terms]), k, K1, B, 5.0)
    return {i: s for b in hits for i, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())}, made


def test_bounds_lose_nothing(monkeypatch):
    """What a task keeps holds the best k, ties included, however documents are cut into blocks."""
    r = random.Random(9)
    docs = {f"d{i}": [r.choice("abcdefgh") for _ in range(r.randint(0, 9))] for i in range(400)} | {"long": ["a"] * 500}
    weights = {"a": 0.7, "b": 2.5, "c": -0.4, "z": 9.0}
    monkeypatch.setattr(P, "BLOCK_TOKENS", 100)
    cut, made = run(docs, 5, weights, True)
    monkeypatch.setattr(P, "BLOCK_TOKENS", 1 << 18)
    whole, _ = run(docs, 5, weights, False)
    score = {}
    for i, w in docs.items():
        c = Counter(w)
        if any(t in c for t in weights):
            score[i] = sum(x * c[t] * (K1 + 1) / (c[t] + K1 * (1 - B + B * len(w) / 5.0)) for t, x in weights.items() if t in c)
    border = sorted(score.values())[-5]
    for got in (cut, whole):
        assert {i for i, s in score.items() if s >= border - 1e-9} <= set(got) and all(abs(score[i] - s) < 1e-9 for i, s in got.items())
    assert max(len(b.column(0)[0].values) for b in made) < 100


def test_groups_of_blocks_are_small(spark, tmp_path):
    """Who reads a block must not get a hundred others with it."""
    import glob

    import pyarrow.parquet as pq

    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(9000))) for i in range(400)], "id long, t string").coalesce(1)
    ws = Workspace(spark, "groups")
    index = R.write_index(docs, "id", "t", ws)
    assert index.blocks.count() >= 10
    for f in glob.glob(f"{ws.path.removeprefix('file://')}/blocks/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        assert all(meta.row_group(i).total_byte_size < 20 << 20 for i in range(meta.num_row_groups))


def test_copies_are_held_k_at_most():
    """Of documents with the very same score, a task holds those with the least ids only."""
    best = P._Best(1, 5, pa.int64())
    for a in range(0, 1600, 400):
        best.add(0, np.r_[np.full(399, 2.0), 3.0], pa.array(range(a, a + 400)))
    scores, ids = best.held[0]
    assert len(ids) <= 10
    assert sorted(zip(-scores, ids.to_pylist()))[:5] == [*((-3.0, 400 * k + 399) for k in range(4)), (-2.0, 0)]


def test_many_queries_fill_the_matrix_in_parts(spark, monkeypatch):
    """However few postings there may be at once, the hits are the same."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(20))) for i in range(200)], "id long, t string")
    index = R.write_index(docs, "id", "t", Workspace(spark, "parts"))
    row = index.blocks.toArrow().to_batches()
    terms = [c * 3 for c in "abcdefgh"]
    q, t = np.repeat(np.arange(30), 4), np.concatenate([np.array(r.sample(range(8), 4)) for _ in range(30)])
    run = lambda: sorted((x["query"], x["id"], x["score"]) for b in P._search(iter(row), list(range(30)), pa.array(terms), q, t, np.ones(len(q)), 5, 1.5, 0.75, 20.0) for x in b.to_pylist())
    whole = run()
    sizes = []
    real = np.bincount
    monkeypatch.setattr(P, "POSTINGS", 400)
    monkeypatch.setattr(P.np, "bincount", lambda x, *a, **k: (sizes.append(len(x)), real(x, *a, **k))[1])
    assert run() == whole
    assert max(sizes) < 1200  # one query has four terms of 200 documents at most


def test_vectors_and_reranking_of_blocks_shuffle_no_postings(spark):
    """Hashed vectors are those of the postings; of these, a search joins its candidates' only."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 30)))) for i in range(300)], "id long, t string")
    queries = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 2}") for q in range(5)], "q long, t string")
    index = R.write_index(docs, "id", "t", Workspace(spark, "slots"))
    dense = lambda df: {r.id: tuple(np.bincount(r.slots, r.counts, 40)) for r in df.collect()}
    for how in ("sha1", "blake2b"):
        assert dense(R.hashed_vectors(docs, "id", "t", 40, None, how, index.blocks)) == dense(R.hashed_vectors(docs, "id", "t", 40, None, how)) != {}
    assert "Exchange" not in R.hashed_vectors(docs, "id", "t", 40, None, "sha1", index.blocks)._jdf.queryExecution().executedPlan().toString()
    terms = R.query_terms(queries.withColumnRenamed("t", "text"), "q", "text")
    near = spark.createDataFrame([(q, 7 * q + k) for q in range(5) for k in range(6)], "query long, id long")
    plain = R.Index(R.postings(docs, "id", "t"), index.terms, index.corpus)
    rows = lambda x: sorted((r.query, r.id, r.rerank) for r in R.lexical_rerank(near, terms, x).collect())
    assert rows(index) == rows(plain) and any(r[2] for r in rows(index))
    asked = {r.id for r in near.collect()}
    assert {r.id for r in P.rows_among(index.blocks, near).collect()} <= asked


def test_common_terms_are_multiplied_and_hits_of_a_block_added_at_once(monkeypatch):
    """All queries' hits in a block are a few additions, not one for each query, whatever share of the terms is common."""
    r = random.Random(5)
    tokens = [[f"t{min(int(r.expovariate(0.08)), 90)}" for _ in range(r.randint(0, 40))] for _ in range(300)] + [["t1", "t2"]] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(tokens))), pa.array(tokens, pa.list_(pa.string()))], names=["id", "tokens"])
    entries = [(q, t, (q * 7 + t) % 5 + 0.5 - 4 * (q == 9)) for q in range(64) for t in sorted(r.sample(range(91), r.randint(1, 12)))]
    query, term, weight = (np.array(x) for x in zip(*entries))
    mean = sum(map(len, tokens)) / len(tokens)
    want = {}
    for q, t, w in entries:
        for d, words in enumerate(tokens):
            tf = words.count(f"t{t}")
            if tf:
                want.setdefault(q, {}).setdefault(d, 0.0)
                want[q][d] += w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
    for sparse in (0, P.SPARSE, 1 << 40):
        calls = []
        monkeypatch.setattr(P, "SPARSE", sparse)
        add = P._BestRows.add
        monkeypatch.setattr(P._BestRows, "add", lambda *x: (calls.append(1), add(*x))[1])
        blocks = [b for i in range(0, 340, 100) for b in P._blocks(iter([batch.slice(i, 100)]))]
        got = {}
        for b in P._search(iter(blocks), list(range(64)), pa.array([f"t{t}" for t in range(91)]), query, term, weight, 4, 1.5, 0.75, mean):
            for q, d, s in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(q, []).append((-round(s, 6), d))
        monkeypatch.undo()
        assert {q: sorted(x)[:4] for q, x in got.items()} == {q: sorted((-round(s, 6), d) for d, s in x.items())[:4] for q, x in want.items()}
        assert len(calls) == len(blocks)
