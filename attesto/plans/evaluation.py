"""Evaluation and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import evaluate as E
from .registry import query, table

_WILSON = """round(k / n, 6) AS rate, round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high"""


@query(f"SELECT role, k, n, {_WILSON} FROM (SELECT role, count(*) FILTER (contains(text, ',')) AS k, count(*) AS n FROM conversations GROUP BY role)")
def rate_wilson(spark, sf):
    """Share of turns with a comma by role, with its interval."""
    return E.rates(table(spark, sf, "conversations"), F.contains("text", F.lit(",")), "role")


@query(f"SELECT lang, k, n, {_WILSON} FROM (SELECT lang, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def toxic_rate_by_language(spark, sf):
    """Share of toxic documents by language, with its interval."""
    return E.rates(table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"), F.col("toxic") == 1, "lang")


_RULES = "SELECT l.doc_id, quality = 1 AS good, toxic = 1 AS toxic, n_chars >= 600 AS r1, contains(text, ',') AND n_chars >= 400 AS r2, lang, n_chars FROM labels l JOIN documents d USING (doc_id)"


def _rules(spark, sf):
    """Labels beside two simple rules for quality."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", (F.col("n_chars") >= 600).alias("r1"), (F.contains("text", F.lit(",")) & (F.col("n_chars") >= 400)).alias("r2"))
    return table(spark, sf, "labels").join(d, "doc_id").withColumns({"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query(f"""WITH r AS ({_RULES}), c AS (SELECT count(*) AS pairs, count(*) FILTER ((r1 <> good) AND (r2 = good)) AS gained, count(*) FILTER ((r1 = good) AND (r2 <> good)) AS lost FROM r),
t AS (SELECT c.*, gained + lost AS n, least(gained, lost) AS m FROM c)
SELECT pairs, gained, lost, round(100.0 * (gained - lost) / pairs, 6) AS points,
  round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 6) AS p FROM t""")
def paired_mcnemar(spark, sf):
    """Two quality rules on the same documents: which is right where they differ."""
    r = _rules(spark, sf)
    return E.paired(r.withColumn("correct", F.col("r1") == F.col("good")), r.withColumn("correct", F.col("r2") == F.col("good")), "doc_id")


def _binary_sql(rule: str, by: str) -> str:
    return f"""WITH r AS ({_RULES}), c AS (SELECT {by}, count(*) FILTER ({rule} AND good)::DOUBLE AS tp, count(*) FILTER ({rule} AND NOT good)::DOUBLE AS fp, count(*) FILTER (NOT {rule} AND good)::DOUBLE AS fn, count(*) FILTER (NOT {rule} AND NOT good)::DOUBLE AS tn FROM r GROUP BY {by}),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s, coalesce(tn / nullif(tn + fn, 0), 0) AS v FROM c),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, coalesce(2 * v * s / nullif(v + s, 0), 0) AS f0 FROM m)
SELECT {by}, round(p, 6) AS precision, round(r, 6) AS recall, round(s, 6) AS specificity, round(f1, 6) AS f1, round((f1 + f0) / 2, 6) AS macro_f1, round((r + s) / 2, 6) AS balanced_accuracy,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM f"""


@query(_binary_sql("r1", "lang"))
def quality_decision_metrics(spark, sf):
    """Precision, recall, F1, MCC of a length rule for quality, by language."""
    good, said = F.col("good"), F.col("r1")
    c = _rules(spark, sf).groupBy("lang").agg(F.count_if(said & good).alias("tp"), F.count_if(said & ~good).alias("fp"), F.count_if(~said & good).alias("fn"), F.count_if(~said & ~good).alias("tn"))
    return c.select("lang", *(F.round(v, 6).alias(k) for k, v in S.binary(*map(F.col, ("tp", "fp", "fn", "tn"))).items()))


@query(f"""WITH r AS ({_RULES}), x AS (SELECT CASE WHEN toxic THEN 'toxic' WHEN good THEN 'good' ELSE 'poor' END AS gold, CASE WHEN NOT r1 THEN 'poor' WHEN r2 THEN 'good' ELSE 'toxic' END AS said FROM r),
l AS (SELECT unnest(['good', 'poor', 'toxic']) AS label), c AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (gold = label AND said = label) AS hits, count(*) FILTER (said = label) AS saids FROM l, x GROUP BY label),
m AS (SELECT *, coalesce(hits / nullif(saids, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM c)
SELECT label, support, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m""")
def confusion_report(spark, sf):
    """Precision, recall and F1 of three classes."""
    x = _rules(spark, sf).select(F.when(F.col("toxic"), "toxic").when(F.col("good"), "good").otherwise("poor").alias("gold"), F.when(~F.col("r1"), "poor").when(F.col("r2"), "good").otherwise("toxic").alias("said"))
    return E.confusion(x, "gold", "said", ["good", "poor", "toxic"])


@query(f"""WITH r AS ({_RULES}), c AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (r1 = r2)::DOUBLE AS o, count(*) FILTER (r1)::DOUBLE AS a, count(*) FILTER (r2)::DOUBLE AS b FROM r GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, round(o / n, 6) AS agreement, round(CASE WHEN (a * b + (n - a) * (n - b)) / (n * n) <> 1 THEN (o / n - (a * b + (n - a) * (n - b)) / (n * n)) / (1 - (a * b + (n - a) * (n - b)) / (n * n)) END, 6) AS kappa FROM c""")
def rule_agreement(spark, sf):
    """Agreement of the two rules and Cohen's kappa."""
    c = _rules(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("r1") == F.col("r2")).alias("o"), F.count_if("r1").alias("a"), F.count_if("r2").alias("b"))
    return c.select("lang", "n", F.round(F.col("o") / F.col("n"), 6).alias("agreement"), F.round(S.kappa(F.col("o"), F.col("a"), F.col("b"), F.col("n")), 6).alias("kappa"))


_SCORE = f"SELECT good, n_chars / (n_chars + 800.0) AS p FROM ({_RULES})"


def _scored(spark, sf):
    return _rules(spark, sf).select("good", (F.col("n_chars") / (F.col("n_chars") + 800.0)).alias("p"))


@query(f"""WITH x AS ({_SCORE}), y AS (SELECT p, good::INT AS y, least(greatest(p, 1e-7), 1 - 1e-7) AS q, least(floor(p * 10), 9) AS bin FROM x),
b AS (SELECT bin, count(*) AS c, abs(avg(p) - avg(y)) AS gap FROM y GROUP BY bin),
rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM y)
SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round((SELECT sum(c * gap) FROM b) / count(*), 6) AS ece,
  round(((SELECT sum(r) FROM rk WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM y""")
def quality_calibration(spark, sf):
    """Brier score, log-loss, calibration error and ROC-AUC of a length score for quality."""
    return E.calibration(_scored(spark, sf), "p", F.col("good"))


@query(f"WITH x AS ({_SCORE}) SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(good::INT), 6) AS accuracy FROM x GROUP BY 1")
def reliability_table(spark, sf):
    """Confidence against accuracy in ten bins."""
    return E.reliability(_scored(spark, sf), "p", F.col("good"))


@query(f"""WITH x AS ({_SCORE}), t AS (SELECT unnest(range(1, 10)) / 10 AS threshold)
SELECT threshold, round(count(*) FILTER (NOT good AND p < threshold) / nullif(count(*) FILTER (NOT good), 0), 6) AS catch_rate, round(count(*) FILTER (good AND p < threshold) / nullif(count(*) FILTER (good), 0), 6) AS false_rejection FROM x, t GROUP BY threshold""")
def threshold_sweep(spark, sf):
    """Catch rate and false rejection at each threshold."""
    x = _scored(spark, sf).withColumn("threshold", F.explode(F.array(*(F.lit(i / 10) for i in range(1, 10)))))
    low, good = F.col("p") < F.col("threshold"), F.col("good")
    return x.groupBy("threshold").agg(F.round(F.try_divide(F.count_if(~good & low).cast("double"), F.count_if(~good)), 6).alias("catch_rate"), F.round(F.try_divide(F.count_if(good & low).cast("double"), F.count_if(good)), 6).alias("false_rejection"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    """Interpolated percentiles of event values."""
    return E.latency(table(spark, sf, "events"), "value", "event_type")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_percentile(spark, sf):
    """Percentiles by nearest rank."""
    return E.nearest_rank(table(spark, sf, "events"), "value", "event_type")


@query("SELECT event_type, value AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = n // 2")
def upper_median(spark, sf):
    """The upper median of event values."""
    return E.upper_median(table(spark, sf, "events"), "value", "event_type")


@query(f"""WITH r AS ({_RULES}), s AS (SELECT unnest(list_filter(['all', CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars >= 1400 THEN 'long' WHEN n_chars >= 800 THEN 'medium' ELSE 'short' END], lambda x: x IS NOT NULL)) AS slice, r1 = good AS hit FROM r)
SELECT slice, k, n, {_WILSON} FROM (SELECT slice, count(*) FILTER (hit) AS k, count(*) AS n FROM s GROUP BY slice)""")
def slice_rates(spark, sf):
    """Accuracy of a rule on slices that overlap."""
    n = F.col("n_chars")
    s = E.slices(_rules(spark, sf), all=F.lit(True), english=F.col("lang") == "en", long=n >= 1400, medium=(n >= 800) & (n < 1400), short=n < 800)
    return E.rates(s, F.col("r1") == F.col("good"), "slice")


@query(f"""WITH r AS ({_RULES}) SELECT lang, toxic, grouping(lang, toxic) AS level, count(*) AS n, count(*) FILTER (r1 = good) AS correct, round(count(*) FILTER (r1 = good) / count(*), 6) AS rate FROM r GROUP BY GROUPING SETS ((), (lang), (toxic), (lang, toxic))""")
def slice_rollup(spark, sf):
    """Accuracy overall, by language, by label and by both."""
    _rules(spark, sf).createOrReplaceTempView("attesto_rules")
    return spark.sql("SELECT lang, toxic, grouping_id(lang, toxic) AS level, count(*) AS n, count_if(r1 = good) AS correct, round(count_if(r1 = good) / count(*), 6) AS rate FROM attesto_rules GROUP BY GROUPING SETS ((), (lang), (toxic), (lang, toxic))")


@query(f"""WITH r AS ({_RULES}), c AS (SELECT lang, toxic, count(*) FILTER (r1 = good) AS k, count(*) AS n FROM r GROUP BY ALL)
SELECT toxic, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, round(sum(k) / sum(n), 6) AS rate FROM c GROUP BY toxic""")
def pooled_rates(spark, sf):
    """Rates pooled over languages: counts are added before they are divided."""
    c = _rules(spark, sf).groupBy("lang", "toxic").agg(F.count_if(F.col("r1") == F.col("good")).alias("k"), F.count("*").alias("n"))
    return E.pooled(c, "k", "n", "toxic").withColumn("rate", F.round("rate", 6))


@query("SELECT k, round(CASE WHEN k = 0 THEN 1.0 ELSE least(1.0, 2 * pow(0.5, k)) END, 9) AS p FROM (SELECT CAST(unnest(range(1, 11)) AS BIGINT) AS k)")
def attainable_significance(spark, sf):
    """The smallest p-value that k discordant pairs, all one way, can reach."""
    return spark.range(1, 11).select(F.col("id").alias("k"), F.round(S.mcnemar(F.col("id"), F.lit(0)), 9).alias("p"))


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) % 2 = 1 THEN 'dev' ELSE 'test' END AS split FROM documents")
def document_split(spark, sf):
    """Halves for tuning and testing, fixed by the ids alone."""
    return E.split_halves(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("""WITH g AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), r AS (SELECT lang, h, row_number() OVER (PARTITION BY lang ORDER BY sha1(h), h) AS r FROM (SELECT DISTINCT lang, h FROM g))
SELECT doc_id, CASE WHEN r % 2 = 1 THEN 'dev' ELSE 'test' END AS split FROM g JOIN r USING (lang, h)""")
def grouped_split(spark, sf):
    """Halves that never part equal texts."""
    g = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return g.join(E.split_halves(g.select("lang", "h").distinct(), "h", "lang"), ["lang", "h"]).select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY sha1('c' || doc_id), doc_id LIMIT 25")
def control_sample(spark, sf):
    """A sample that the ids fix: the first 25 by hash."""
    return table(spark, sf, "documents").select("doc_id").orderBy(F.sha1(F.concat(F.lit("c"), F.col("doc_id").cast("string"))), "doc_id").limit(25)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS length FROM e WHERE event_type = 'error' GROUP BY user_id, g HAVING count(*) >= 3""")
def error_streaks(spark, sf):
    """Three and more errors in a row of a user."""
    return E.islands(table(spark, sf, "events"), F.col("event_type") == "error", ["ts", "event_id"], "user_id").where("length >= 3")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf):
    """Sessions of events at most 30 minutes apart."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES")
    s = table(spark, sf, "events").withColumn("new", F.when(gap, 0).otherwise(1)).withColumn("s", F.sum("new").over(w))
    return s.groupBy("user_id", "s").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("s")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS peak, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_tumbling(spark, sf):
    """Count, peak and mean of values in each hour."""
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "peak", "mean")


@query("""SELECT r_name AS region, n_name AS nation, grouping(r_name, n_name) AS level, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def star_join_report(spark, sf):
    """Orders by region and nation, with totals."""
    o, c = table(spark, sf, "orders").select("o_custkey", "o_totalprice"), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    # Nations and regions are fixed dimension tables of 25 and 5 rows.
    n, r = F.broadcast(table(spark, sf, "nation")), F.broadcast(table(spark, sf, "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.grouping_id().alias("level"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
