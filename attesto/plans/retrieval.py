"""Search queries: documents are the corpus, benchmark passages the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import STOP_WORDS, Retrieval
from ..operators import retrieval as R
from ..storage import Workspace
from .registry import query, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
FOLD = "replace(replace(lower({0}), 'ß', 'ss'), 'ё', 'е')"
TOKENS = "list_filter(regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN (" + _STOP + "))"
NORMAL = r"trim(regexp_replace(" + FOLD + r", '\s+', ' ', 'g'))"

INDEX_SQL = f"""
tok AS (SELECT doc_id AS id, unnest({TOKENS.format("text")}) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
n AS (SELECT count(*) AS n FROM documents),
corpus AS (SELECT n, (SELECT sum(dl) FROM dl) / n AS avgdl FROM n),
df AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM tf, n GROUP BY term),
terms AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM df) ELSE idf0 END AS idf FROM df),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL)
"""
BM25_SQL = INDEX_SQL + """,
bm AS (
  SELECT query, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN terms USING (term) JOIN qt USING (term) JOIN dl USING (id), corpus GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 60),
cover AS (SELECT query, sum(CASE WHEN df IS NULL THEN 0 ELSE qtf END) / sum(qtf) AS weight FROM qt LEFT JOIN terms USING (term) GROUP BY query)
"""
_SLOT = "CAST(('0x' || substr(sha1(term), 1, 12)) AS BIGINT) % 384"
HYBRID_SQL = BM25_SQL + f""",
dv AS (SELECT id, {_SLOT} AS slot, sum(tf) AS c FROM tf GROUP BY ALL),
dn AS (SELECT id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM dv),
qv AS (SELECT query, {_SLOT} AS slot, sum(qtf) AS c FROM qt GROUP BY ALL),
qn AS (SELECT query, slot, c / sqrt(sum(c * c) OVER (PARTITION BY query)) AS w FROM qv),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
  SELECT query, id, round(sum(dn.w * qn.w), 6) AS score FROM dn JOIN qn USING (slot) GROUP BY ALL)) WHERE rank <= 60),
fused AS (SELECT query, id, round(sum(part), 9) AS rrf, list_sort(list(source)) AS sources FROM (
  SELECT query, id, 1.0 / (60 + rank) AS part, 'dense' AS source FROM dense
  UNION ALL SELECT query, id, weight / (60 + rank), 'sparse' FROM sparse JOIN cover USING (query) WHERE weight > 0) GROUP BY query, id),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, id) AS r FROM fused) WHERE r <= 60),
need AS (SELECT query, count(*) AS need FROM qt GROUP BY query),
held AS (SELECT c.query, c.id, count(*) AS held FROM cand c JOIN qt ON qt.query = c.query JOIN tf ON tf.id = c.id AND tf.term = qt.term GROUP BY ALL),
scored AS (SELECT c.query, c.id, rrf, sources, round(coalesce(held, 0) / need, 6) AS rerank, weight
  FROM cand c LEFT JOIN held USING (query, id) JOIN need ON need.query = c.query JOIN cover ON cover.query = c.query),
mixed AS (SELECT *, round(0.2 * rrf / ((1.0 + weight) / 61) + 0.8 * rerank, 6) AS final, rerank >= 0.5 AS eligible FROM scored),
ranked AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY query, eligible ORDER BY final DESC, rrf DESC, id) END AS rank FROM mixed)
"""


@query(f"""WITH tok AS MATERIALIZED (SELECT unnest(list_distinct({TOKENS.format("text")})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
f AS MATERIALIZED (SELECT term, count(*) AS df FROM tok GROUP BY term), r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM f, n), a AS (SELECT avg(idf0) AS m FROM r)
SELECT term, df, round(CASE WHEN idf0 < 0 THEN 0.25 * m ELSE idf0 END, 6) AS idf FROM r, a""")
def postings_stats(spark, sf):
    """Document frequency and idf of every term."""
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _index(spark, sf):
    return R.write_index(table(spark, sf, "documents"), "doc_id", "text", Workspace(spark, "index"))


def _hybrid(spark, sf, index=None):
    """The search with hashes that SQL has, too."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return R.hybrid(docs, bench, "doc_id", "item_id", "text", Retrieval(), index or _index(spark, sf), how="sha1")


@query(f"WITH {BM25_SQL} SELECT query AS item_id, id AS doc_id, score, rank FROM sparse")
def bm25_topk(spark, sf):
    """The 60 best documents of each question by BM25."""
    hits = R.bm25(_index(spark, sf), R.query_terms(table(spark, sf, "benchmark"), "item_id", "text"))
    return hits.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {BM25_SQL} SELECT query AS item_id, round(weight, 6) AS weight FROM cover")
def bm25_coverage_weight(spark, sf):
    """The weight of the lexical ranking by the share of question terms that the corpus has."""
    w = R.coverage(_index(spark, sf), R.query_terms(table(spark, sf, "benchmark"), "item_id", "text"))
    return w.select(F.col("query").alias("item_id"), F.round("weight", 6).alias("weight"))


_COSINE = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
_NEAR = f"near AS (SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS score, q.label AS ql, v.label AS vl FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"


@query(f"WITH {_NEAR} SELECT * EXCLUDE (ql, vl) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= 60")
def dense_topk(spark, sf):
    """The 60 nearest vectors of every vector whose id is divisible by 50."""
    v = table(spark, sf, "embeddings")
    hits = R.nearest(v, v.where("vec_id % 50 = 0"))
    return hits.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


@query(f"""WITH {_NEAR.replace(" WHERE q.vec_id % 50 = 0", "")}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near WHERE query_id <> vec_id),
votes AS (SELECT query_id, ql, vl, count(*) AS votes FROM top WHERE rank <= 15 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, vl) AS r FROM votes)
SELECT query_id, ql AS label, vl AS predicted, votes FROM best WHERE r = 1""")
def label_knn_vote(spark, sf):
    """The most common label among the 15 nearest other vectors of every vector; the smallest on ties."""
    v = table(spark, sf, "embeddings")
    near = R.nearest(v, v, k=15, itself=False)
    votes = near.join(v.select(F.col("vec_id").alias("id"), F.col("label").alias("predicted")), "id").groupBy("query", "predicted").agg(F.count("*").alias("votes"))
    best = R.top(votes, "votes", 1, then="predicted")
    return best.join(v.select(F.col("vec_id").alias("query"), "label"), "query").select(F.col("query").alias("query_id"), "label", "predicted", "votes")


@query(f"WITH {HYBRID_SQL} SELECT query AS item_id, id AS doc_id, rrf, sources FROM cand")
def hybrid_rrf(spark, sf):
    """Fused candidates of the lexical and the hashed-vector ranking."""
    h = _hybrid(spark, sf)
    return h.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rrf", "sources")


@query(f"WITH {HYBRID_SQL} SELECT query AS item_id, id AS doc_id, rrf, rerank, final, rank FROM ranked WHERE rank <= 5")
def hybrid_search(spark, sf):
    """The five best documents of each question: fusion, reranking, gate."""
    h = _hybrid(spark, sf)
    return h.where("rank <= 5").select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rrf", "rerank", "final", "rank")


@query(f"""WITH {HYBRID_SQL}, g AS (SELECT *, bool_or(rerank >= 0.7) OVER (PARTITION BY query) AS open FROM mixed)
SELECT query AS item_id, count(*) AS candidates, CAST(sum(CASE WHEN rerank >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS chunk_scope, CAST(sum(CASE WHEN open THEN 1 ELSE 0 END) AS BIGINT) AS top_scope, max(rerank) AS best FROM g GROUP BY query""")
def lexical_rerank_gate(spark, sf):
    """How many candidates each scope of the gate lets through at 0.7."""
    h = _hybrid(spark, sf)
    g = R.gate(h.withColumnRenamed("eligible", "e0"), Retrieval(rerank_threshold=0.7)).withColumnRenamed("eligible", "chunk")
    g = R.gate(g, Retrieval(rerank_threshold=0.7, gate_scope="top"))
    return g.groupBy(F.col("query").alias("item_id")).agg(F.count("*").alias("candidates"), F.count_if("chunk").alias("chunk_scope"), F.count_if("eligible").alias("top_scope"), F.max("rerank").alias("best"))


_GOLD = f"gold AS (SELECT b.item_id, d.doc_id FROM (SELECT item_id, {NORMAL.format('text')} AS q FROM benchmark) b JOIN (SELECT doc_id, {NORMAL.format('text')} AS t FROM documents) d ON contains(d.t, b.q) WHERE b.q <> '')"


@query(f"WITH {_GOLD} SELECT * FROM gold")
def benchmark_containment(spark, sf):
    """Documents that hold a benchmark passage word for word, normalised."""
    found = R.containing(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id", "text")
    return found.select(F.col("quote").alias("item_id"), F.col("id").alias("doc_id"))


def _metrics_sql(source: str) -> str:
    at = lambda k: f"""round(count(*) FILTER (rank <= {k}) / count(*), 6) AS recall_{k}, CAST(count(*) FILTER (rank <= {k}) > 0 AS DOUBLE) AS hit_{k},
  round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, least(count(*), {k}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}"""  # noqa: E731
    return f"SELECT item_id, count(*) AS units, {at(1)}, {at(3)}, {at(5)}, {at(10)}, round(coalesce(max(1 / rank) FILTER (rank <= 10), 0), 6) AS mrr_10 FROM gold LEFT JOIN (SELECT query AS item_id, id AS doc_id, rank FROM {source}) USING (item_id, doc_id) GROUP BY item_id"


@query(f"WITH {BM25_SQL}, {_GOLD} {_metrics_sql('sparse')}")
def retrieval_metrics(spark, sf):
    """Recall, hit, nDCG and reciprocal rank of the lexical ranking, by question that has an answer."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    gold = R.containing(docs, bench, "doc_id", "item_id", "text").withColumnRenamed("quote", "query")
    return R.ranking_metrics(R.bm25(_index(spark, sf), R.query_terms(bench, "item_id", "text")), gold).withColumnRenamed("query", "item_id")


@query(f"""WITH {HYBRID_SQL}, {_GOLD},
full_rank AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY 0.2 * rrf / (2.0 / 61) + 0.8 * rerank DESC, id) AS rank FROM scored),
variants AS (SELECT 'dense' AS variant, query, id, rank FROM dense UNION ALL SELECT 'sparse', query, id, rank FROM sparse
  UNION ALL SELECT 'rrf', query, id, r FROM cand UNION ALL SELECT 'rerank', query, id, rank FROM full_rank UNION ALL SELECT 'final', query, id, rank FROM ranked WHERE rank IS NOT NULL),
best AS (SELECT variant, g.item_id, min(rank) AS rank FROM (SELECT unnest(['dense','sparse','rrf','rerank','final']) AS variant) v CROSS JOIN gold g LEFT JOIN variants x USING (variant) WHERE x.query = g.item_id AND x.id = g.doc_id GROUP BY ALL)
SELECT v.variant, count(*) AS questions, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_10
FROM (SELECT unnest(['dense','sparse','rrf','rerank','final']) AS variant) v CROSS JOIN (SELECT DISTINCT item_id FROM gold) q LEFT JOIN best b ON b.variant = v.variant AND b.item_id = q.item_id GROUP BY v.variant""")
def retrieval_ablation(spark, sf):
    """Five rankings of the same search beside each other."""
    docs, bench, c, index = table(spark, sf, "documents"), table(spark, sf, "benchmark"), Retrieval(), _index(spark, sf)
    terms, ws = R.query_terms(bench, "item_id", "text"), Workspace(spark, "ablation")
    h = ws.save(_hybrid(spark, sf, index).withColumnRenamed("rank", "r"), "hybrid")
    unscaled = h.withColumn("mixed", c.rerank_alpha * F.col("rrf") / ((c.dense_weight + c.sparse_weight) / (c.rrf_k + 1)) + (1 - c.rerank_alpha) * F.col("rerank"))
    lists = {
        "dense": R.hashed_search(R.hashed_vectors(docs, "doc_id", "text", stored=index.postings, how="sha1", blocks=index.blocks), R.hashed_vectors(bench, "item_id", "text", how="sha1")),
        "sparse": R.bm25(index, terms),
        "rrf": R.top(h, "rrf", 60),
        "rerank": R.top(unscaled, "mixed", 60),
        "final": h.where("r is not null").withColumnRenamed("r", "rank"),
    }
    gold = ws.save(R.containing(docs, bench, "doc_id", "item_id", "text").withColumnRenamed("quote", "query"), "gold")
    out = None
    for name, ranked in lists.items():
        best = ranked.join(gold, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("rank"))
        row = gold.select("query").distinct().join(best, "query", "left").select(F.lit(name).alias("variant"), "rank")
        out = row if out is None else out.unionByName(row)
    return out.groupBy("variant").agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), 6).alias("hit_5"), F.round(F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_10"))


@query(f"""WITH {HYBRID_SQL}, {_GOLD}, best AS (SELECT query, max(rerank) AS best FROM scored GROUP BY query),
q AS (SELECT item_id, coalesce(best, 0) AS best, item_id IN (SELECT item_id FROM gold) AS answerable FROM benchmark LEFT JOIN best ON best.query = item_id),
t AS (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (answerable AND best < threshold) AS answerable_rejected, count(*) FILTER (NOT answerable AND best < threshold) AS unanswerable_rejected,
  count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable FROM q, t GROUP BY threshold""")
def gate_threshold_sweep(spark, sf):
    """What each gate threshold rejects, among questions with and without an answer in the corpus."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    h = _hybrid(spark, sf)
    gold = R.containing(docs, bench, "doc_id", "item_id", "text").select(F.col("quote").alias("item_id")).distinct().withColumn("answerable", F.lit(True))
    best = h.groupBy(F.col("query").alias("item_id")).agg(F.max("rerank").alias("best"))
    q = bench.select("item_id").join(best, "item_id", "left").join(gold, "item_id", "left").select(F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("answerable", F.lit(False)).alias("answerable"))
    grid = q.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)))))
    low = F.col("best") < F.col("threshold")
    return grid.groupBy("threshold").agg(F.count_if(F.col("answerable") & low).alias("answerable_rejected"), F.count_if(~F.col("answerable") & low).alias("unanswerable_rejected"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"))


@query(f"WITH {HYBRID_SQL.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))')} SELECT query AS item_id, id AS doc_id, rrf, final, rank FROM ranked WHERE rank <= 5")
def complete_search(spark, sf):
    """The five best documents of each question among those that labels name, as if only they were stored whole."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    h = R.hybrid(docs, bench, "doc_id", "item_id", "text", Retrieval(), how="sha1", complete=table(spark, sf, "labels").select("doc_id"))
    return h.where("rank <= 5").select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rrf", "final", "rank")
