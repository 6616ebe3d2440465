"""Further analyses: flags of chunks, neighbours, sweeps, routes, changes between runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import claims as C
from ..operators import experiments as X
from ..operators import parse as P
from ..operators import retrieval as R
from ..operators import summarize as M
from .experiments import _LOG, _log
from .registry import query, table
from .retrieval import _GOLD, BM25_SQL, HYBRID_SQL, _hybrid, _index


@query(r"""SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, NOT regexp_matches(rtrim(text), '[.!?。！？:;»"”)\]]$') AS cut_off,
  substr(sha1(concat_ws(chr(31), CAST(doc_id AS VARCHAR), text)), 1, 16) AS stable_id, source || ' > ' || lang || ', стр. ' || CAST(doc_id AS VARCHAR) AS citation FROM documents""")
def chunk_flags(spark, sf):
    """Slug of the first line, open end, stable id and citation of documents."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"), T.ends_inside_sentence("text").alias("cut_off"), T.stable_id("doc_id", "text").alias("stable_id"), T.citation(F.array("source", "lang"), "doc_id", "doc_id").alias("citation"))


@query("""WITH l AS (SELECT conv_id, turn, text, lead(text) OVER w AS nx, lag(text) OVER w AS pv FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, length(coalesce(pv || chr(10), '') || text || coalesce(chr(10) || nx, '')) AS expanded FROM l""")
def neighbour_expansion(spark, sf):
    """Sizes of turns joined with their neighbours."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("\n", F.lag("text").over(w), "text", F.lead("text").over(w)).alias("t"))
    return x.select("conv_id", "turn", F.length("t").cast("long").alias("expanded"))


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CAST(i * least(3, n) // n AS INT) AS paragraph FROM r""")
def paragraph_layout(spark, sf):
    """Turns spread over at most three paragraphs."""
    return M.paragraphs(table(spark, sf, "conversations").select("conv_id", "turn"), "turn", "conv_id")


@query(f"""WITH {HYBRID_SQL}, {_GOLD}, a AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha), t AS (SELECT unnest([0.4, 0.6, 0.8])::DOUBLE AS threshold),
f AS (SELECT alpha, threshold, query, id, rerank, round(alpha * rrf / (2.0 / 61) + (1 - alpha) * rerank, 6) AS v, rrf FROM scored, a, t WHERE rerank >= threshold),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha, threshold, query ORDER BY v DESC, rrf DESC, id) AS rank FROM f),
b AS (SELECT alpha, threshold, query, min(rank) AS rank FROM r JOIN gold ON gold.item_id = query AND gold.doc_id = id GROUP BY ALL)
SELECT alpha, threshold, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 5) AS hit_5, round(sum(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS mrr FROM b GROUP BY ALL""")
def alpha_threshold_sweep(spark, sf):
    """Ranking quality on a grid of mixing weights and gates."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    h = _hybrid(spark, sf).select("query", "id", "rrf", "rerank")
    grid = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("threshold")) for a in (0.0, 0.25, 0.5, 0.75, 1.0) for t in (0.4, 0.6, 0.8)))
    x = h.withColumn("g", F.explode(grid)).select("g.*", "query", "id", "rrf", "rerank").where("rerank >= threshold")
    x = x.withColumn("v", F.round(F.col("alpha") * F.col("rrf") / (2.0 / 61) + (1 - F.col("alpha")) * F.col("rerank"), 6))
    rank = F.row_number().over(Window.partitionBy("alpha", "threshold", "query").orderBy(F.desc("v"), F.desc("rrf"), "id"))
    gold = R.containing(docs, bench, "doc_id", "item_id", "text").withColumnRenamed("quote", "query")
    best = x.withColumn("rank", rank).join(gold, ["query", "id"]).groupBy("alpha", "threshold", "query").agg(F.min("rank").alias("rank"))
    return best.groupBy("alpha", "threshold").agg(F.count_if(F.col("rank") <= 1).alias("hit_1"), F.count_if(F.col("rank") <= 5).alias("hit_5"), F.round(F.sum(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"))


_ROUTES = {"draft": "base_correct", "final": "correct", "final_if_long": "CASE WHEN n_chars >= 1400 THEN correct ELSE base_correct END", "final_if_refused": "CASE WHEN base_refused THEN correct ELSE base_correct END"}
_CALLS = {"draft": "1", "final": "2", "final_if_long": "CASE WHEN n_chars >= 1400 THEN 2 ELSE 1 END", "final_if_refused": "CASE WHEN base_refused THEN 2 ELSE 1 END"}


@query(f"WITH {_LOG}, u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS route, {c} AS ok, {_CALLS[n]} AS calls FROM log" for n, c in _ROUTES.items()) + ") SELECT route, count(*) FILTER (ok) AS correct, count(*) AS cases, CAST(sum(calls) AS BIGINT) AS calls FROM u GROUP BY route")
def router_evaluation(spark, sf):
    """Correct cases and calls of four routes."""
    routes = F.array(*(F.struct(F.lit(n).alias("route"), F.expr(c).alias("ok"), F.expr(_CALLS[n]).alias("calls")) for n, c in _ROUTES.items()))
    u = _log(spark, sf).select(F.explode(routes).alias("r")).select("r.*")
    return u.groupBy("route").agg(F.count_if("ok").alias("correct"), F.count("*").alias("cases"), F.sum("calls").cast("long").alias("calls"))


@query(f"""WITH {_LOG} SELECT lang, list_sort(list(doc_id) FILTER (base_correct AND NOT correct)) AS lost, list_sort(list(doc_id) FILTER (hallucination AND base_correct)) AS invented, count(*) FILTER (correct AND NOT base_correct) AS gained FROM log GROUP BY lang""")
def regressions(spark, sf):
    """Cases that a change lost or made invent."""
    lost, new = F.col("base_correct") & ~F.col("correct"), F.col("hallucination") & F.col("base_correct")
    g = _log(spark, sf).groupBy("lang").agg(F.array_sort(F.collect_list(F.when(lost, F.col("doc_id")))).alias("lost"), F.array_sort(F.collect_list(F.when(new, F.col("doc_id")))).alias("invented"), F.count_if(F.col("correct") & ~F.col("base_correct")).alias("gained"))
    none = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return g.select("lang", none("lost"), none("invented"), "gained")


@query(f"""WITH {HYBRID_SQL}, d AS (SELECT query, id FROM dense WHERE rank <= 5), s AS (SELECT query, id FROM sparse WHERE rank <= 5)
SELECT coalesce(d.query, s.query) AS item_id, count(*) FILTER (s.id IS NULL) AS only_dense, count(*) FILTER (d.id IS NULL) AS only_sparse, count(*) FILTER (d.id IS NOT NULL AND s.id IS NOT NULL) AS both FROM d FULL JOIN s ON d.query = s.query AND d.id = s.id GROUP BY 1""")
def ranking_changes(spark, sf):
    """How the first five of two rankings differ."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    index = _index(spark, sf)
    dense = R.hashed_search(R.hashed_vectors(docs, "doc_id", "text", stored=index.postings, how="sha1", blocks=index.blocks), R.hashed_vectors(bench, "item_id", "text", how="sha1"), 5)
    d = dense.select("query", "id", F.lit(True).alias("d"))
    s = R.bm25(index, R.query_terms(bench, "item_id", "text"), 5).select("query", "id", F.lit(True).alias("s"))
    j = d.join(s, ["query", "id"], "full")
    return j.groupBy(F.col("query").alias("item_id")).agg(F.count_if(F.col("s").isNull()).alias("only_dense"), F.count_if(F.col("d").isNull()).alias("only_sparse"), F.count_if(F.col("d") & F.col("s")).alias("both"))


_NLI = "n AS (SELECT vec_id, abs(e[1]) * 2 AS ae, abs(e[2]) AS ac, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE abs(e[3]) * 2 END AS be, abs(e[4]) AS bc FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))"


@query(f"""WITH {_NLI} SELECT vec_id, how, round(e, 6) AS e, round(c, 6) AS c FROM (
 SELECT vec_id, 'min' AS how, CASE WHEN be IS NOT NULL THEN least(ae, be) END AS e, CASE WHEN be IS NOT NULL THEN greatest(ac, bc) END AS c FROM n
 UNION ALL SELECT vec_id, 'mean', CASE WHEN be IS NOT NULL THEN (ae + be) / 2 END, CASE WHEN be IS NOT NULL THEN (ac + bc) / 2 END FROM n
 UNION ALL SELECT vec_id, 'first_veto', ae, CASE WHEN be IS NOT NULL THEN greatest(ac, bc) ELSE ac END FROM n)""")
def nli_ensembles(spark, sf):
    """Two models' scores joined in three ways; one of them can't score some pairs."""
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    m = lambda p, c: F.struct(p.alias("e"), F.lit(0.0).alias("n"), c.alias("c"))
    a, b = m(e(0) * 2, e(1)), F.when(F.col("vec_id") % 7 != 0, m(e(2) * 2, e(3)))
    x = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*(F.struct(F.lit(how).alias("how"), C.ensemble(a, b, how).alias("p")) for how in ("min", "mean", "first_veto")))).alias("x"))
    return x.select("vec_id", "x.how", F.round("x.p.e", 6).alias("e"), F.round("x.p.c", 6).alias("c"))


@query(f"""WITH {_LOG}, t AS (SELECT unnest(range(1, 11)) * 300 AS threshold), g AS (SELECT threshold, count(*) FILTER ((n_chars >= threshold) = answerable) AS correct, count(*) FILTER (NOT answerable AND n_chars >= threshold) AS invented FROM log, t GROUP BY 1)
SELECT threshold, correct, invented FROM g WHERE invented <= (SELECT count(*) FILTER (hallucination) FROM log) ORDER BY correct DESC, threshold DESC LIMIT 1""")
def best_threshold(spark, sf):
    """The setting that gets most cases right without inventing more than the log; the highest on ties."""
    log = _log(spark, sf)
    most = log.agg(F.count_if("hallucination").alias("most"))
    g = log.withColumn("threshold", F.explode(F.array(*(F.lit(300 * i).cast("long") for i in range(1, 11)))))
    g = g.groupBy("threshold").agg(F.count_if((F.col("n_chars") >= F.col("threshold")) == F.col("answerable")).alias("correct"), F.count_if(~F.col("answerable") & (F.col("n_chars") >= F.col("threshold"))).alias("invented"))
    return g.join(F.broadcast(most), F.col("invented") <= F.col("most")).orderBy(F.desc("correct"), F.desc("threshold")).limit(1).select("threshold", "correct", "invented")


@query(r"""WITH n AS (SELECT doc_id, text, regexp_replace(text, '(?is)^((?:.*?[^\p{L}\p{N}_])??)(?:не|not)\s+', '\1') AS gone,
  regexp_replace(text, '(?is)^((?:.*?[^\p{L}\p{N}_])??)(is|are|was|were|can|must|may|should|shall|will)([^\p{L}\p{N}_]|$)', '\1\2 not\3') AS put FROM documents)
SELECT doc_id, sha256(CASE WHEN gone <> text THEN gone ELSE put END) AS sha FROM n WHERE gone <> text OR put <> text""")
def stress_negation(spark, sf):
    """Documents with their first negation taken out, or one put in."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.negate("text"), 256).alias("sha")).where("sha is not null")


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
c AS (SELECT a.conv_id, a.turn, b.turn AS other, (b.i - a.i + a.n) % a.n AS dist FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.i <> b.i WHERE NOT contains(lower(a.text), lower(b.text)) AND NOT contains(lower(b.text), lower(a.text)))
SELECT conv_id, turn, arg_min(other, dist) AS other FROM c GROUP BY ALL""")
def wrong_row_partner(spark, sf):
    """For each turn the next one of its conversation, around the end, that neither holds it nor is held by it."""
    w = Window.partitionBy("conv_id")
    t = table(spark, sf, "conversations").withColumns({"i": F.row_number().over(w.orderBy("turn")) - 1, "n": F.count("*").over(w), "x": F.lower("text")})
    a, b = t.select("conv_id", "turn", "i", "n", "x"), t.select(F.col("conv_id").alias("c2"), F.col("turn").alias("other"), F.col("i").alias("j"), F.col("x").alias("y"))
    # Conversations are short and bounded by their turns.
    on = (F.col("conv_id") == F.col("c2")) & (F.col("i") != F.col("j")) & ~F.contains("x", F.col("y")) & ~F.contains("y", F.col("x"))
    return a.join(b, on).groupBy("conv_id", "turn").agg(F.min_by("other", F.pmod(F.col("j") - F.col("i") + F.col("n"), F.col("n"))).alias("other"))


@query(r"""WITH s AS (SELECT item_id, unnest(range(len(a))) AS i, unnest(a) AS s FROM (SELECT item_id, string_split(text, chr(10)) AS a FROM benchmark)), f AS (SELECT item_id, s AS quote FROM s WHERE i = 0),
w AS (SELECT s.item_id, i, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\p{L}\p{N}]{4,}')), list_distinct(regexp_extract_all(lower(quote), '[\p{L}\p{N}]{4,}')))) AS c FROM s JOIN f USING (item_id) WHERE i > 0)
SELECT item_id, CAST(arg_max(i, struct_pack(c := c, i := -i)) AS INT) AS best, max(c) AS shared FROM w GROUP BY item_id""")
def best_matching_line(spark, sf):
    """The line, after the first, that shares most long words with the first; the earliest on ties."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)))
    s = P.lines(table(spark, sf, "benchmark"), "item_id", "text")
    first = s.where("seq = 0").select("id", words("line").alias("q"))
    x = s.where("seq > 0").join(first, "id").select("id", "seq", F.size(F.array_intersect(words("line"), F.col("q"))).alias("c"))
    return x.groupBy(F.col("id").alias("item_id")).agg(F.max_by("seq", F.struct("c", -F.col("seq"))).alias("best"), F.max("c").cast("long").alias("shared"))


@query(f"""WITH {BM25_SQL}, c AS (SELECT query, id FROM sparse WHERE rank <= 10), f AS (SELECT query, count(*) AS candidates, count(*) FILTER (n_chars >= 1400) AS long_ones, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM c JOIN documents ON doc_id = id GROUP BY query)
SELECT item_id, coalesce(candidates, 0) AS candidates, coalesce(long_ones, 0) AS long_ones, langs FROM benchmark LEFT JOIN f ON query = item_id""")
def retrieval_snapshot(spark, sf):
    """What each question's first ten documents look like."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    c = R.bm25(_index(spark, sf), R.query_terms(bench, "item_id", "text"), 10).join(docs.select(F.col("doc_id").alias("id"), "n_chars", "lang"), "id")
    f = c.groupBy(F.col("query").alias("item_id")).agg(F.count("*").alias("candidates"), F.count_if(F.col("n_chars") >= 1400).alias("long_ones"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return bench.select("item_id").join(f, "item_id", "left").select("item_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("long_ones", F.lit(0)).alias("long_ones"), "langs")
