"""Experiment queries: logs of outcomes are derived from labels and two simple rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import experiments as X
from ..operators import parse as P
from .evaluation import _RULES, _rules
from .registry import query, table
from .retrieval import NORMAL

_LOG = f"""log AS (SELECT doc_id, lang, good AS answerable, n_chars < 500 AS base_refused, r1 = good AS base_correct, n_chars < 500 OR toxic AS refused, (r2 = good) AS correct, CASE WHEN NOT good THEN r2 END AS hallucination, n_chars FROM ({_RULES}))"""


def _log(spark, sf):
    r = _rules(spark, sf)
    return r.select("doc_id", "lang", F.col("good").alias("answerable"), (F.col("n_chars") < 500).alias("base_refused"), (F.col("r1") == F.col("good")).alias("base_correct"), ((F.col("n_chars") < 500) | F.col("toxic")).alias("refused"), (F.col("r2") == F.col("good")).alias("correct"), F.when(~F.col("good"), F.col("r2")).alias("hallucination"), "n_chars")


def _summary_sql(by: str) -> str:
    return f"""SELECT {by}, cases, round(k / cases, 6) AS accuracy, round(kb / cases, 6) AS base_accuracy, round(h / nullif(hn, 0), 6) AS hallucination, round(ar / nullif(a, 0), 6) AS false_refusal, round(ac / nullif(a - ar, 0), 6) AS selective_accuracy, gained, lost, k - kb AS net,
  round((coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc
FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (
 SELECT {by}, count(*) AS cases, count(*) FILTER (correct) AS k, count(*) FILTER (base_correct) AS kb, count(*) FILTER (hallucination) AS h, count(hallucination) AS hn, count(*) FILTER (answerable) AS a, count(*) FILTER (answerable AND refused) AS ar, count(*) FILTER (answerable AND NOT refused AND correct) AS ac,
  count(*) FILTER (correct AND NOT base_correct) AS gained, count(*) FILTER (base_correct AND NOT correct) AS lost,
  (count(*) FILTER (NOT base_refused AND base_correct AND NOT refused))::DOUBLE AS tp, (count(*) FILTER (NOT base_refused AND NOT base_correct AND NOT refused))::DOUBLE AS fp, (count(*) FILTER (NOT base_refused AND base_correct AND refused))::DOUBLE AS fn, (count(*) FILTER (NOT base_refused AND NOT base_correct AND refused))::DOUBLE AS tn FROM log GROUP BY {by}))"""


@query(f"WITH {_LOG} {_summary_sql('lang')}")
def outcome_summary(spark, sf):
    """Accuracy, hallucination, false refusal and the filter's quality by language."""
    return X.summary(_log(spark, sf), "lang")


@query(f"""WITH {_LOG}, o AS (SELECT doc_id, NOT correct AS correct, false AS refused FROM log WHERE doc_id % 2 = 0)
SELECT log.doc_id, CASE WHEN log.refused AND o.doc_id IS NOT NULL THEN o.correct ELSE log.correct END AS correct, CASE WHEN log.refused AND o.doc_id IS NOT NULL THEN o.refused ELSE log.refused END AS refused FROM log LEFT JOIN o USING (doc_id)""")
def replaced_when_refused(spark, sf):
    """A run whose refused cases take the outcome of a second run that has them."""
    log = _log(spark, sf)
    other = log.where("doc_id % 2 = 0").select("doc_id", (~F.col("correct")).alias("correct"), F.lit(False).alias("refused"))
    return X.replaced(log.select("doc_id", "correct", "refused"), other, "doc_id", F.col("refused"), ["correct", "refused"])


@query(f"""WITH r AS ({_RULES}), s AS (SELECT k AS step, (SELECT count(*) FILTER ((n_chars >= 200 * k) = good) FROM r) AS correct FROM (SELECT CAST(unnest(range(0, 8)) AS INT) AS k))
SELECT step, correct, lag(correct) OVER (ORDER BY step) AS previous, correct - lag(correct) OVER (ORDER BY step) AS delta FROM s""")
def ablation_ladder(spark, sf):
    """Correct cases along eight settings of a rule, each beside the one before."""
    r = _rules(spark, sf).withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(8)))))
    return X.ladder(r.groupBy("step").agg(F.count_if((F.col("n_chars") >= 200 * F.col("step")) == F.col("good")).alias("correct")), "step", "correct")


@query(f"""WITH r AS ({_RULES}), g AS (SELECT n_chars::DOUBLE AS s, count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS u FROM r GROUP BY 1),
x AS (SELECT s, lag(s) OVER (ORDER BY s) AS low, coalesce(sum(a) OVER w, 0) / (SELECT sum(a) FROM g) AS fr, coalesce(sum(u) OVER w, 0) / (SELECT sum(u) FROM g) AS rj FROM g WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT coalesce((s + low) / 2, s) AS threshold, round(fr, 6) AS false_rejection, round(rj, 6) AS rejection FROM x WHERE fr <= 0.05 ORDER BY rj DESC, s DESC LIMIT 1""")
def gate_calibration(spark, sf):
    """The length threshold that rejects most poor documents at 5% of good ones."""
    r = _rules(spark, sf).select(F.col("n_chars").cast("double").alias("s"), "good")
    return X.calibrate_gate(r, "s", "good", 0.05).select("threshold", F.round("false_rejection", 6).alias("false_rejection"), F.round("rejection", 6).alias("rejection"))


_ENS = "s AS (SELECT label AS query, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS r FROM embeddings)"


@query(f"""WITH {_ENS}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY a DESC, id) AS ra, row_number() OVER (PARTITION BY query ORDER BY b DESC, id) AS rb FROM s),
l AS (SELECT 'first' AS strategy, query, id, a AS v FROM k UNION ALL SELECT 'second', query, id, b FROM k UNION ALL SELECT 'mean', query, id, (a + b) / 2 FROM k UNION ALL SELECT 'max', query, id, greatest(a, b) FROM k
 UNION ALL SELECT 'by_script', query, id, CASE WHEN query % 3 = 0 THEN a ELSE b END FROM k
 UNION ALL SELECT 'rank_fusion', query, id, 1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb) FROM k UNION ALL SELECT 'no_rerank', query, id, r FROM k)
SELECT * FROM (SELECT strategy, query, id, row_number() OVER (PARTITION BY strategy, query ORDER BY v DESC, id) AS rank FROM l) WHERE rank <= 3""")
def rerank_ensembles(spark, sf):
    """The three best candidates by seven ways to combine two rerankers."""
    e = lambda i: F.col("embedding")[i].cast("double")
    s = table(spark, sf, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), e(0).alias("a"), e(1).alias("b"), e(2).alias("r"))
    return X.rerank_ensembles(s, "a", "b", "r", script=F.when(F.col("query") % 3 == 0, "ru").otherwise("en")).where("rank <= 3")


@query("""WITH c AS (SELECT conv_id, turn, role, turn % 2 = 0 AS supported FROM conversations), r AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn <= 2)
SELECT coalesce(t.conv_id, g.conv_id) AS conv_id, round(good / nullif(n, 0), 6) AS precision, round(coalesce(found, 0) / wanted, 6) AS recall
FROM (SELECT conv_id, count(*) AS wanted FROM r GROUP BY 1) t FULL JOIN (SELECT c.conv_id, count(*) AS n, count(*) FILTER (supported AND r.role IS NOT NULL) AS good, count(DISTINCT r.role) AS found FROM c LEFT JOIN r USING (conv_id, role) GROUP BY 1) g USING (conv_id)""")
def citation_metrics(spark, sf):
    """Precision and recall of citations: turns cite their role, the first three turns' roles are relevant."""
    c = table(spark, sf, "conversations").select("conv_id", "role", (F.col("turn") % 2 == 0).alias("supported"), "turn")
    return X.citation_metrics(c, c.where("turn <= 2"), "conv_id", "role")


_W = "list_distinct(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {_W.format("a.text")} AS x, {_W.format("b.text")} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(len(list_intersect(y, x)) / greatest(len(y), 1), 6) AS faithfulness, round(len(list_intersect(x, y)) / greatest(len(x), 1), 6) AS answer_relevancy FROM p""")
def answer_proxies(spark, sf):
    """Token coverage between neighbouring turns."""
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    p = X.proxies(F.col("text"), F.col("answer"), F.col("answer"), F.col("text"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(p["faithfulness"], 6).alias("faithfulness"), F.round(p["answer_relevancy"], 6).alias("answer_relevancy"))


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS o, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
n AS (SELECT doc_id, o, {NORMAL.format("t")} AS t FROM l), r AS (SELECT doc_id, o AS first, o AS last, t FROM n UNION ALL SELECT a.doc_id, a.o, b.o, a.t || ' ' || b.t FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.o = a.o + 1
 UNION ALL SELECT a.doc_id, a.o, c.o, a.t || ' ' || b.t || ' ' || c.t FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.o = a.o + 1 JOIN n c ON a.doc_id = c.doc_id AND c.o = a.o + 2),
q AS (SELECT doc_id, doc_id AS quote_id, substr({NORMAL.format("text")}, greatest(length({NORMAL.format("text")}) // 2 - 30, 1), 60) AS q FROM documents)
SELECT quote_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last FROM (SELECT quote_id, first, last, min(last - first) OVER (PARTITION BY quote_id) AS m FROM q JOIN r USING (doc_id) WHERE contains(t, trim(q))) WHERE last - first = m""")
def quote_binding(spark, sf):
    """The lines, or the shortest runs of them, that hold a passage from the middle of each document."""
    d = table(spark, sf, "documents")
    chunks = P.lines(d, "doc_id", "text").select(F.col("id").alias("document_id"), F.col("seq").alias("ordinal"), F.col("line").alias("text"))
    t = T.normalize("text")
    quote = F.substring(t, F.greatest(F.floor(F.length(t) / 2).cast("int") - 30, F.lit(1)), F.lit(60))
    return X.bind_quotes(chunks, d.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("document_id"), quote.alias("quote")))


@query("""WITH RECURSIVE s AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn FROM conversations),
f AS (SELECT conv_id, turn, i, n <= 500 AS included, CASE WHEN n <= 500 THEN n ELSE 0 END AS used FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.turn, s.i, f.used + s.n <= 500, f.used + CASE WHEN f.used + s.n <= 500 THEN s.n ELSE 0 END FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
SELECT conv_id, turn, included FROM f""")
def context_packing(spark, sf):
    """Turns that a context of 500 characters takes; one that doesn't fit is skipped."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return X.pack_context(c, "conv_id", "turn", "n", 500).select("conv_id", "turn", "included")


@query()
def sentence_chunks(spark, sf):
    """Chunks of whole sentences with overlaps."""
    return X.sentence_chunks(table(spark, sf, "documents"), "doc_id", "text").select("doc", "ordinal", "tokens", "error", F.sha2("text", 256).alias("sha"))


@query(r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(ltrim(trim(x), '#'))), lambda x: x <> '') AS l FROM documents),
t AS (SELECT *, nullif(substr(split_part(trim(regexp_replace(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ' | ', 1), 1, 160), '') AS html,
  nullif(regexp_extract(text, 'Request for Comments:\s*(\d+)', 1), '') AS rfc, coalesce(list_position(list_transform(l, lambda x: lower(x)), 'abstract'), 0) AS spot FROM l)
SELECT doc_id, substr(coalesce(html, CASE WHEN rfc IS NOT NULL THEN 'RFC ' || rfc || CASE WHEN spot > 1 THEN ': ' || l[spot - 1] ELSE '' END END, list_filter(l, lambda x: len(regexp_extract_all(x, '\p{L}')) >= 3)[1]), 1, 160) AS title FROM t""")
def document_titles(spark, sf):
    """Titles of documents."""
    return table(spark, sf, "documents").select("doc_id", X.title("text").alias("title"))


@query(f"WITH r AS ({_RULES}) SELECT CASE WHEN toxic AND r1 THEN 'published_toxic' WHEN good AND NOT r1 THEN 'lost_good' WHEN NOT good AND r1 THEN 'kept_poor' WHEN r1 <> r2 THEN 'rules_differ' ELSE 'fine' END AS error, lang, count(*) AS n FROM r GROUP BY ALL")
def error_classes(spark, sf):
    """The first matching class of error of each case."""
    r = _rules(spark, sf)
    c = F.when(F.col("toxic") & F.col("r1"), "published_toxic").when(F.col("good") & ~F.col("r1"), "lost_good").when(~F.col("good") & F.col("r1"), "kept_poor").when(F.col("r1") != F.col("r2"), "rules_differ").otherwise("fine")
    return r.groupBy(c.alias("error"), "lang").agg(F.count("*").alias("n"))


@query(f"""WITH {_LOG} SELECT CASE WHEN base_correct AND correct THEN 'A' WHEN base_correct THEN 'B' WHEN correct THEN 'C' ELSE 'D' END AS quadrant, refused, count(*) AS n, list_sort(list(doc_id))[1] AS example FROM log GROUP BY ALL""")
def paired_quadrants(spark, sf):
    """Cases by what draft and answer got right, and whether they were refused."""
    q = F.when(F.col("base_correct") & F.col("correct"), "A").when(F.col("base_correct"), "B").when(F.col("correct"), "C").otherwise("D")
    return _log(spark, sf).groupBy(q.alias("quadrant"), "refused").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


@query(f"""WITH {_LOG}, v AS (SELECT doc_id, unnest(['draft', 'final', 'either']) AS variant, unnest([base_correct, correct, base_correct OR correct]) AS ok FROM log)
SELECT variant, split, count(*) FILTER (ok) AS k, count(*) AS n FROM (SELECT variant, ok, unnest(['all', CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END]) AS split FROM v) GROUP BY ALL""")
def acceptance_by_split(spark, sf):
    """Accepted and all cases of each variant, overall and in each half."""
    log = _log(spark, sf)
    v = log.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), c.alias("ok")) for n, c in (("draft", F.col("base_correct")), ("final", F.col("correct")), ("either", F.col("base_correct") | F.col("correct")))))).alias("v"))
    s = v.select("v.*", F.explode(F.array(F.lit("all"), F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test"))).alias("split"))
    return s.groupBy("variant", "split").agg(F.count_if("ok").alias("k"), F.count("*").alias("n"))


@query(f"""WITH {_LOG}, m AS (SELECT lang, median(n_chars) AS m, count(*) FILTER (refused) AS calls FROM log GROUP BY lang) SELECT lang, m AS median_cost, calls, m * calls AS planned FROM m""")
def run_time_plan(spark, sf):
    """Expected cost of repeating the refused cases of each language at its median cost."""
    return _log(spark, sf).groupBy("lang").agg(F.median("n_chars").alias("median_cost"), F.count_if("refused").alias("calls")).withColumn("planned", F.col("median_cost") * F.col("calls"))
