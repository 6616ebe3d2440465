"""Operators on pairs that don't make the pairs, against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesto.operators import claims as C
from attesto.operators import evaluate as E
from attesto.operators import questions as Q
from attesto.operators import retrieval as R
from attesto.operators import runs as N
from attesto.operators import summarize as M
from attesto.storage import Workspace


def test_resamples_are_sums_of_tasks(spark):
    """The same interval as from all draws at once, however rows are dealt."""
    rows = [(i, i % 3 == 0, i % 7 == 0 if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, x boolean, y boolean")
    hashed = df.where("y is not null").select(F.xxhash64(F.lit("b"), "k").alias("h"), (F.col("x").cast("int") - F.col("y").cast("int")).alias("d")).collect()
    w, d = E.poisson_draws(np.array([r.h for r in hashed]), 150), np.array([r.d for r in hashed])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    points = 100.0 * (w * d[:, None]).sum(axis=0) / w.sum(axis=0)
    want = (round(100.0 * d.mean(), 6), *(round(float(np.percentile(points, p)), 6) for p in (2.5, 97.5)))
    for n in (1, 7):
        assert tuple(E.bootstrap_difference(df.repartition(n), "k", "x", "y", 150).first()) == pytest.approx(want, abs=2e-6)


def swapped(cases):
    """By the definition, over all pairs of a group."""
    norm = lambda s: re.sub(r"\s+", " ", s.lower().replace("ß", "ss").replace("ё", "е")).strip()
    out = {}
    for key, group, claim, answer in cases:
        a = (answer or "").strip(' "«»')
        if len(a) < 2 or not norm(a):
            continue
        best = None
        for o in {x[3].strip(' "«»') for x in cases if x[1] == group and x[3] is not None}:
            x, y = norm(a), norm(o)
            if bool(re.search("[0-9]", a)) == bool(re.search("[0-9]", o)) and y and x not in y and y not in x:
                best = min(best or (9**9, ""), (abs(len(o) - len(a)), o))
        at = claim.lower().find(a.lower())
        if best and at >= 0 and norm(best[1]) not in norm(claim):
            out[key] = (best[1], claim[:at] + best[1] + claim[at + len(a) :])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_answers_of_near_length(spark, seed):
    """Few letters, so that many answers hold one another and the first ones of a length settle nothing."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab1") for _ in range(r.randint(1, 5))) if r.random() < 0.8 else "a" * r.randint(1, 9)
    cases = []
    for k in range(300):
        a = r.choice([word(), f'"{word()}"', "", " "]) if k % 20 else None
        cases.append((k, k % 4, f"it is {a or 'nothing'} so", a))
    got = N.answer_swaps(spark.createDataFrame(cases, "k long, g long, c string, a string").repartition(3), "k", "g", "c", "a").collect()
    assert {x.k: (x.other, x.text) for x in got} == swapped(cases)


def test_a_group_of_many_answers(spark):
    df = spark.range(100_000).select("id", F.lit(1).alias("g"), F.format_string("w%05d", "id").alias("a")).withColumn("c", F.concat(F.lit("it is "), "a"))
    got = N.answer_swaps(df, "id", "g", "c", "a").agg(F.count("*").alias("n"), F.count_if(F.col("other") == "w00000").alias("first")).first()
    assert (got.n, got.first) == (100_000, 99_999)


@pytest.mark.parametrize("most", [4, 1 << 14])
def test_nearest_windows(spark, monkeypatch, most):
    monkeypatch.setattr(M, "WINDOWS", most)
    g = np.random.default_rng(3)
    windows = [(int(i % 3), f"S{i % 4}", int(i), g.integers(-2, 3, 4).astype(float).tolist(), float(i)) for i in range(60)]
    claims = [(int(i % 4), int(i), g.integers(-2, 3, 4).astype(float).tolist(), [[], ["S1"], ["S0", "S3"], ["S9"]][i % 4]) for i in range(40)]
    w = spark.createDataFrame(windows, "g int, source_id string, w int, vector array<double>, c double")
    c = spark.createDataFrame(claims, "g int, i int, vector array<double>, source_ids array<string>")
    got = {(r.g, r.i): (r.w, r.source_id, r.c) for r in M.nearest_windows(c, w, "g", "i").collect()}

    def cosine(a, b):
        n = np.sqrt(np.dot(a, a) * np.dot(b, b))
        return round(float(np.dot(a, b) / n), 9) + 0.0 if n else 0.0

    want = {}
    for group, i, v, cited in claims:
        some = [(cosine(v, x), -n, s, c_) for h, s, n, x, c_ in windows if h == group and (not cited or s in cited)]
        if some:
            s, n, name, c_ = max(some)
            want[group, i] = (-n, name, c_)
    assert got == want


def test_parts_of_questions(spark):
    docs = spark.createDataFrame([(1, "the valve opens at forty bar"), (2, "the pump stops when the tank is empty"), (3, "the alarm rings"), (4, None)], "id long, t string")
    asked = spark.createDataFrame([("q", "When does the valve open and why does the alarm ring?"), ("p", "Why does the pump stop?"), ("n", None)], "k string, t string")
    parts = Q.parts(asked, "k", "t")
    assert sorted((r.k, r.part, r.text) for r in parts.collect()) == [("q", 0, "When does the valve open"), ("q", 1, "why does the alarm ring?")]
    index = R.write_index(docs, "id", "t", Workspace(spark, "parts"))
    base = spark.createDataFrame([("q", 1)], "k string, id long")
    more = Q.added_hits(index, parts, base, "k", 1)
    assert [(r.k, r.id, r.part, r.rank) for r in more.collect()] == [("q", 3, 1, 1)]
    covered = Q.part_coverage(parts, {"before": base, "after": base.unionByName(more.select("k", "id"))}, docs, "k", "id", "t")
    got = {r.part: (r.before, r.after) for r in covered.collect()}
    assert got[0][0] == got[0][1] > 0 and got[1][0] < got[1][1]
    assert tuple(Q.coverage_gain(covered, "before", "after").first())[0] == 2 and Q.coverage_gain(covered, "before", "after").first().gained == 1


def test_chunks_that_follow(spark):
    chunks = spark.createDataFrame([(1, "d", 0, "It ends."), (2, "d", 1, "it goes"), (3, "d", 2, "on here."), (4, "e", 0, "no end")], "id long, document_id string, ordinal int, text string")
    hits = spark.createDataFrame([("q", 1), ("q", 2), ("r", 2), ("r", 3), ("s", 4)], "k string, id long")
    assert [(r.k, r.id) for r in Q.next_chunks(hits, chunks, "k").collect()] == [("q", 3)]


def test_texts_are_not_sorted_by_source(spark, sf):
    """What orders the chunks of a source carries a mark for each, not its text."""
    from attesto import plans

    df = plans.QUERIES["following_chunks"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan()

    def outputs(node):
        own = [node.child().output().mkString(",")] if node.nodeName() == "Window" and "source" in node.partitionSpec().mkString(",") else []
        children = node.children()
        return own + [x for i in range(children.size()) for x in outputs(children.apply(i))]

    found = outputs(plan)
    assert found and not any("text#" in x for x in found)


def test_stored_texts_are_not_sorted_by_source(spark, sf, monkeypatch):
    """What numbers the chunks of a source before they are stored carries no text."""
    from attesto import plans
    from attesto.sources import store

    added, add = [], store.ChunkStore.add
    monkeypatch.setattr(store.ChunkStore, "add", lambda self, chunks: added.append(chunks) or add(self, chunks))
    plans.QUERIES["chunk_store"](spark, sf)

    def outputs(node):
        own = [node.child().output().mkString(",")] if node.nodeName() == "Window" else []
        children = node.children()
        return own + [x for i in range(children.size()) for x in outputs(children.apply(i))]

    assert len(added) == 2
    for chunks in added:
        found = outputs(chunks._jdf.queryExecution().optimizedPlan())
        assert found and not any("text#" in x for x in found)


def test_what_co_verification_lets_through(spark):
    true = "the long pump of the plant moves clean water to the upper tank every day"
    contexts = spark.createDataFrame([("a", f"Short one. {true}. Another short one."), ("b", f"{true}. The upper tank feeds the plant."), ("c", "Too short. None here.")], "k string, text string")
    probes = spark.createDataFrame([("a", "Lions eat fresh meat in warm deserts."), ("b", "The clean water plant moves the pump to lions."), ("c", "Anything at all."), ("d", "No text.")], "k string, h string")
    got = {r.k: (r.leaked, r.co_verified) for r in C.co_verification_stress(probes, contexts, "k", "h").collect()}
    assert got == {"a": (False, False), "b": (True, True)}


def test_a_task_keeps_its_best_of_all_batches():
    """Many batches leave k rows for each query, with ties by id; a matrix of scores has a bounded number of cells."""
    import numpy as np
    import pyarrow as pa

    from attesto.operators import retrieval as R

    r = np.random.default_rng(5)
    ids, matrix = np.arange(100, 140), r.integers(-2, 3, (40, 3)).astype(float) + 0.5
    v = r.integers(-2, 3, (3000, 3)).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 100)), pa.array(v[a : a + 100].tolist(), pa.list_(pa.float32()))], names=["id", "v"]) for a in range(0, 3000, 100)]
    matrix = R._unit(matrix)
    got = [tuple(x.values()) for b in R._nearest(iter(batches), ids, matrix, 7, 6) for x in b.to_pylist()]
    score = np.round(matrix @ R._unit(v.astype(float)).T, 6) + 0.0
    want = [(int(ids[q]), int(d), float(score[q, d])) for q in range(40) for d in sorted(range(3000), key=lambda d: (-score[q, d], d))[:7]]
    assert sorted(got) == sorted(want)


def test_a_claim_travels_once(spark):
    """What is a claim's own stands once, however many sources and windows it meets."""
    marks = "".join(f"[S{k}]" for k in range(1, 31))
    answers = spark.createDataFrame([(1, f"The valve opens at 40 bar. It shuts at night {marks}."), (2, "Nobody knows the code.")], "k long, answer string")
    contexts = spark.createDataFrame([(1, f"S{k}", "The valve opens at 40 bar. It shuts at night. It is red.") for k in range(1, 31)], "k long, source_id string, text string")
    c = C.inherit(C.claims(answers, "k", "answer"), "k").withColumn("kind", C.kind("claim"))
    rules = C.Rules()
    x = C.scored(C.paired(c, C.prepared(contexts, "k", rules), "k", rules), "k", C.heuristic_nli).cache()
    assert x.count() == 2 * 30 * 6 + 1
    assert x.where("claim_row is not null").count() == 3
    assert x.where("h is not null").count() == 2 * 30 + 1
    g = C.by_source(x, "k")
    assert {(r.k, r.ix, r.support, r.e) for r in g.collect()} == {(1, 0, "window", 1.0), (1, 1, "window", 1.0), (2, 0, None, None)}
    x.unpersist()
    assert sorted((r.k, r.ix, len(r.source_ids), r.status) for r in C.verify(answers, contexts, "k", "answer").collect()) == [(1, 0, 30, "verified"), (1, 1, 30, "verified"), (2, 0, 0, "unverified")]


def test_fold_over_many_claims(spark, monkeypatch):
    """A summary of several blocks of claims, held one by one against those accepted before."""
    monkeypatch.setattr(M, "FOLD", 7)
    monkeypatch.setattr(M, "ACCEPTED", 5)
    r = np.random.default_rng(4)
    v = r.normal(size=(90, 3)).round(2)
    v[40] = 0
    ok = r.random(90) > 0.2
    near, accepted = M._fold(v, ok, 0.85)
    kept = []
    for i, x in enumerate(v):
        size = lambda y: np.sqrt((x @ x) * (y @ y))
        best = max((x @ y / size(y) if size(y) else 0.0 for y in kept), default=0.0)
        assert abs(best - near[i]) < 1e-9 and accepted[i] == (ok[i] and best <= 0.85)
        if accepted[i]:
            kept.append(x)
    assert 5 < len(kept) < 60
