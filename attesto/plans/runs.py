"""Queries over logs of runs.  A log is derived from labels and documents: what an answer came to, and why it was withheld."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import experiments as X
from ..operators import retrieval as R
from ..operators import runs as N
from .analyses import _NLI
from .documents import _DECIDED, _JUDGED, _judged
from .evaluation import _RULES, _rules
from .experiments import _LOG, _log
from .registry import query, table
from .retrieval import _GOLD, BM25_SQL, _index

_CASES = f"""cases AS (SELECT *, reason IS NOT NULL AS refused FROM (SELECT doc_id, lang, n_chars, good, toxic, r1, r2, doc_id % 97 / 97 AS best, doc_id % 89 / 89 AS least_confidence, 1 + doc_id % 3 AS attempts,
  CASE WHEN n_chars < 400 THEN 'llm_refusal' WHEN toxic THEN 'nli_verification_failed' WHEN n_chars > 9000 THEN 'context_budget_exceeded' WHEN NOT good AND NOT r2 THEN 'relevance_threshold_not_met' END AS reason,
  CASE doc_id % 4 WHEN 0 THEN ['supported'] WHEN 1 THEN ['supported', 'ambiguous'] WHEN 2 THEN ['contradicted'] ELSE ['insufficient_evidence'] END AS grades,
  CASE doc_id % 4 WHEN 0 THEN ['verified'] WHEN 1 THEN ['verified', 'unverified'] WHEN 2 THEN ['contradiction'] ELSE []::VARCHAR[] END AS statuses,
  CASE doc_id % 5 WHEN 0 THEN 'What is it and how does it work?' WHEN 1 THEN 'Что это?' WHEN 2 THEN 'Who? Where?' ELSE 'Name it' END AS question FROM ({_RULES})))"""


def _cases(spark, sf):
    i = F.col("doc_id")
    pick = lambda n, *values: F.when(i % n == 0, values[0]).when(i % n == 1, values[1]).when(i % n == 2, values[2]).otherwise(values[3])
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    r = _rules(spark, sf).select("doc_id", "lang", "n_chars", "good", "toxic", "r1", "r2", (i % 97 / 97.0).alias("best"), (i % 89 / 89.0).alias("least_confidence"), (1 + i % 3).alias("attempts"))
    reason = F.when(F.col("n_chars") < 400, "llm_refusal").when(F.col("toxic"), "nli_verification_failed").when(F.col("n_chars") > 9000, "context_budget_exceeded").when(~F.col("good") & ~F.col("r2"), "relevance_threshold_not_met")
    return r.withColumns({
        "reason": reason, "refused": reason.isNotNull(), "grades": pick(4, words("supported"), words("supported", "ambiguous"), words("contradicted"), words("insufficient_evidence")),
        "statuses": pick(4, words("verified"), words("verified", "unverified"), words("contradiction"), words()),
        "question": pick(5, F.lit("What is it and how does it work?"), F.lit("Что это?"), F.lit("Who? Where?"), F.lit("Name it")),
    })


_W = "(refused AND reason NOT IN ('relevance_threshold_not_met', 'context_budget_exceeded'))"
_C = "list_has_any(grades, ['contradicted', 'ambiguous', 'partially_supported'])"
_ROUTES = [
    ("never", None, "false"), ("first_refusal", None, "coalesce(reason = 'llm_refusal' AND attempts = 1, false)"), ("withheld", None, _W), ("withheld_or_conflict", None, f"{_W} OR NOT refused AND {_C}"),
    ("withheld_or_several_parts", None, f"{_W} OR NOT refused AND doc_id % 5 IN (0, 2)"), ("always", None, "true"),
    *(("withheld_or_low_retrieval", x, f"{_W} OR NOT refused AND best < {x}") for x in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    *(("withheld_or_low_confidence", x, f"{_W} OR NOT refused AND least_confidence < {x}") for x in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    *(("adaptive", x, f"{_W} OR NOT refused AND ({_C} OR least_confidence < {x} OR best < 0.05)") for x in (0.4, 0.5, 0.6, 0.7, 0.8)),
]


@query(f"WITH {_CASES} " + " UNION ALL ".join(f"SELECT '{n}' AS route, {'NULL' if x is None else x}::DOUBLE AS threshold, count(*) FILTER ({c}) AS routed FROM cases" for n, x, c in _ROUTES))
def route_decisions(spark, sf):
    """How many cases each route sends to a second pass."""
    return N.routes(_cases(spark, sf), "doc_id").groupBy("route", "threshold").agg(F.count_if("routed").alias("routed"))


@query(f"""WITH {_CASES}, x AS (SELECT *, n_chars < 600 AS think_refused, doc_id % 83 / 83 AS think_confidence, {_W} AS routed FROM cases)
SELECT policy, chosen, count(*) AS n FROM (SELECT policy, CASE WHEN routed AND (refused OR NOT think_refused AND (policy = 'replace' OR think_confidence >= least_confidence)) THEN 'think' ELSE 'base' END AS chosen FROM x, (SELECT unnest(['replace', 'confidence']) AS policy)) GROUP BY ALL""")
def router_choices(spark, sf):
    """Which result counts, by two policies."""
    x = _cases(spark, sf).withColumns({"think_refused": F.col("n_chars") < 600, "think_confidence": F.col("doc_id") % 83 / 83.0})
    routed = F.col("refused") & ~F.coalesce(F.col("reason").isin(*N.EXEMPT), F.lit(False))
    made = [F.struct(F.lit(p).alias("policy"), N.chosen(F.col("refused"), F.col("think_refused"), F.col("least_confidence"), F.col("think_confidence"), routed, p).alias("chosen")) for p in ("replace", "confidence")]
    return x.select(F.explode(F.array(*made)).alias("x")).select("x.*").groupBy("policy", "chosen").agg(F.count("*").alias("n"))


@query(f"""WITH {_CASES} SELECT doc_id, coalesce(reason = 'llm_refusal' AND best >= 0.5, false) AS recovery, coalesce(reason = 'llm_refusal', false) AS think_strict, reason IS NOT NULL AND reason <> 'context_budget_exceeded' AS think,
  NOT refused AND len(list_filter(statuses, lambda s: s <> 'verified')) > 0 AS trimmed, NOT refused AND len(list_filter(statuses, lambda s: s <> 'verified')) = 0 AS whole,
  CASE WHEN reason IN ('relevance_threshold_not_met', 'llm_refusal') AND doc_id % 5 = 1 THEN 'en' END AS translate_to FROM cases""")
def pass_predicates(spark, sf):
    """What passes each case is due."""
    r, s = F.col("reason"), F.col("statuses")
    return _cases(spark, sf).select(
        "doc_id", N.recovery_due(r, F.col("best"), 0.5).alias("recovery"), N.think_retry(r, "llm_refusal").alias("think_strict"), N.think_retry(r, "refusal").alias("think"),
        N.trimmed(F.col("refused"), s).alias("trimmed"), N.fully_verified(F.col("refused"), s).alias("whole"), N.translation_due(r, F.col("question"), F.lit("an English text")).alias("translate_to"),
    )


@query(f"""WITH {_CASES} SELECT doc_id FROM cases WHERE reason = 'llm_refusal' AND best >= 0.05 UNION SELECT doc_id FROM cases WHERE n_chars < 500 AND least_confidence >= 0.05""")
def recovery_population(spark, sf):
    """Cases of two logs that end in a refusal with a relevant source."""
    c = _cases(spark, sf)
    other = c.select("doc_id", F.when(F.col("n_chars") < 500, "llm_refusal").alias("reason"), F.col("least_confidence").alias("best"))
    return N.recovery_population([c.select("doc_id", "reason", "best"), other], "doc_id")


@query(f"""WITH {_CASES}, x AS (SELECT *, {_W} AS routed, CASE WHEN n_chars >= 300 THEN 'think' END AS think_published, CASE WHEN n_chars < 300 THEN 'llm_refusal' END AS think_reason FROM cases),
y AS (SELECT *, routed AND reason = 'nli_verification_failed' AND doc_id % 2 = 0 AS revise FROM x),
z AS (SELECT *, CASE WHEN revise THEN CASE WHEN doc_id % 3 = 0 THEN 'revised' END WHEN routed THEN think_published WHEN NOT refused THEN 'base' END AS published,
  CASE WHEN revise THEN CASE WHEN doc_id % 3 <> 0 THEN 'nli_verification_failed' END WHEN routed THEN think_reason ELSE reason END AS why FROM y),
w AS (SELECT *, coalesce(why = 'llm_refusal' AND best >= 0.3, false) AS due FROM z)
SELECT doc_id, CASE WHEN due AND doc_id % 5 = 0 OR revise OR NOT routed THEN 'base' ELSE 'think' END AS config, CASE WHEN due AND doc_id % 5 = 0 THEN 'recovered' ELSE published END AS published, CAST(routed AS INT) AS calls,
  due AND doc_id % 5 = 0 AS recovered, 100.0::DOUBLE + CASE WHEN routed THEN 300 ELSE 0 END + CASE WHEN due THEN 50 ELSE 0 END AS ms FROM w""")
def candidate_run(spark, sf):
    """A run of routes, revisions and recoveries over logged results."""
    i = F.col("doc_id")
    c = _cases(spark, sf).withColumns({"base_published": F.when(~F.col("refused"), "base"), "base_reason": F.col("reason"), "base_ms": F.lit(100.0), "think_published": F.when(F.col("n_chars") >= 300, "think")})
    c = c.withColumns({
        "think_reason": F.when(F.col("n_chars") < 300, "llm_refusal"), "think_ms": F.lit(300.0), "revise_reason_known": i % 2 == 0, "revise_published": F.when(i % 3 == 0, "revised"),
        "recover_published": F.when(i % 5 == 0, "recovered"), "recover_ms": F.lit(50.0),
    })
    routed = F.col("refused") & ~F.coalesce(F.col("reason").isin(*N.EXEMPT), F.lit(False))
    return N.candidate_run(c.withColumn("routed", routed), "doc_id", F.col("routed"), 0.3)


@query("SELECT conv_id, turn, sha1(conv_id || chr(31) || turn || chr(31) || role || chr(31) || text) AS name FROM conversations")
def revision_keys(spark, sf):
    """Names of revisions."""
    return table(spark, sf, "conversations").select("conv_id", "turn", N.revision_key("conv_id", "turn", "role", "text").alias("name"))


_ATTEMPTS = """m AS (SELECT conv_id, turn, role, text, length(text) % 2 = 0 AS refused, CASE WHEN length(text) % 2 = 0 THEN CASE WHEN length(text) % 3 = 0 THEN 'nli_verification_failed' ELSE 'llm_refusal' END END AS reason, length(text) % 4 AS claims FROM conversations)"""


def _attempts(spark, sf):
    """Turns as attempts: the user's are drafts, the assistant's thoughts, each run of one mode with repairs."""
    n = F.length("text")
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("thinking"), F.lit(False).alias("recovery"), (n % 2 == 0).alias("refused"), (n % 4).alias("claims"), (n % 2 == 1).alias("published"), n.alias("n"))
    c = c.withColumn("reason", F.when(F.col("refused"), F.when(F.col("n") % 3 == 0, "nli_verification_failed").otherwise("llm_refusal")))
    return N.attempt_roles(c, "conv_id", "turn")


_REPLAYED = f"""{_ATTEMPTS}, a AS (SELECT *, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS t FROM m), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) AS g FROM a),
o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id, t, g ORDER BY turn) % 2 = 1 THEN CASE t WHEN 1 THEN 'think' ELSE 'draft' END ELSE CASE t WHEN 1 THEN 'think_repair' ELSE 'repair' END END AS role2 FROM g),
q AS (SELECT conv_id, list(struct_pack(turn := turn, refused := refused, reason := reason, claims := claims) ORDER BY turn) FILTER (role2 = 'draft') AS d, list(struct_pack(turn := turn, refused := refused, reason := reason, claims := claims) ORDER BY turn) FILTER (role2 = 'repair') AS r,
  list(struct_pack(turn := turn, refused := refused, reason := reason, claims := claims) ORDER BY turn) FILTER (role2 = 'think') AS t, list(struct_pack(turn := turn, refused := refused, reason := reason, claims := claims) ORDER BY turn) FILTER (role2 = 'think_repair') AS tr FROM o GROUP BY conv_id),
s AS (SELECT conv_id, list_concat(CASE WHEN d[1] IS NULL THEN [] ELSE [d[1]] END, coalesce(r, [])[1:2]) AS x, d[1] IS NULL AS md, list_concat(CASE WHEN t[1] IS NULL THEN [] ELSE [t[1]] END, coalesce(tr, [])[1:2]) AS y, t[1] IS NULL AS mt FROM q),
n AS (SELECT *, CASE WHEN md THEN 0 ELSE 1 + CASE WHEN len(x) > 1 AND x[1].refused AND x[1].claims > 0 THEN 1 + CASE WHEN len(x) > 2 AND x[2].refused AND x[2].claims > 0 THEN 1 ELSE 0 END ELSE 0 END END AS n1,
  CASE WHEN mt THEN 0 ELSE 1 + CASE WHEN len(y) > 1 AND y[1].refused AND y[1].claims > 0 THEN 1 + CASE WHEN len(y) > 2 AND y[2].refused AND y[2].claims > 0 THEN 1 ELSE 0 END ELSE 0 END END AS n2 FROM s),
u AS (SELECT *, NOT md AND x[n1].reason IS NOT NULL AS thinks FROM n),
replayed AS (SELECT conv_id, list_concat(CASE WHEN n1 > 0 THEN ['draft'] ELSE [] END, list_transform(range(1, n1), lambda i: 'repair'), CASE WHEN thinks AND n2 > 0 THEN ['think'] ELSE [] END, CASE WHEN thinks THEN list_transform(range(1, n2), lambda i: 'think_repair') ELSE [] END) AS path,
  CASE WHEN thinks AND n2 > 0 THEN y[n2].turn ELSE x[n1].turn END AS final, CASE WHEN thinks AND n2 > 0 THEN y[n2].reason ELSE x[n1].reason END AS reason FROM u)"""


@query(f"WITH {_REPLAYED} SELECT * FROM replayed")
def case_replay(spark, sf):
    """What logged attempts come to when refusals are repaired twice and thought over."""
    a = _attempts(spark, sf)
    cases = a.select("conv_id").distinct().withColumn("best", F.lit(0.0))
    return N.replay(a, cases, "conv_id", "turn", samples=0).select("conv_id", "path", "final", "reason")


@query(f"""WITH {_ATTEMPTS}, a AS (SELECT *, lag(NOT refused) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) AS r FROM m)
SELECT conv_id FROM a WHERE role = 'assistant' AND r = 1 AND before""")
def thoughts_after_publication(spark, sf):
    """Cases that were thought over although something was published."""
    return N.think_on_trim(_attempts(spark, sf), "conv_id", "turn")


@query(f"""WITH {_REPLAYED}, f AS (SELECT conv_id, max(turn) AS logged, arg_max(reason IS NULL, turn) AS shown FROM m GROUP BY conv_id), j AS (SELECT * FROM replayed JOIN f USING (conv_id))
SELECT count(*) AS cases, count(*) AS whole, count(*) FILTER (final IS NOT DISTINCT FROM logged) AS same_result, count(*) FILTER ((reason IS NULL) = shown) AS same_publication FROM j""")
def replay_agreement(spark, sf):
    """A replay under other settings beside the log."""
    a = _attempts(spark, sf)
    made = N.replay(a, a.select("conv_id").distinct().withColumn("best", F.lit(0.0)), "conv_id", "turn", samples=0)
    last = a.groupBy("conv_id").agg(F.max("turn").alias("final"), F.max_by("reason", "turn").alias("reason"))
    return N.replay_agreement(made.withColumn("missing", F.lit(None).cast("string")), last, "conv_id")


@query("""WITH x AS (SELECT conv_id, turn, length(text) % 7 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 7 DESC, turn) AS place FROM conversations) SELECT conv_id, turn, place FROM x WHERE place <= 2""")
def top_sources(spark, sf):
    """The two best sources of each case."""
    x = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 7).alias("score"))
    return N.top_sources(x, "conv_id", "score", "turn").select("conv_id", "turn", "place")


@query(f"""WITH {_JUDGED}, {_DECIDED}, y AS (SELECT *, sup OR (ac < 0.2 AND (a > 0.4 OR a >= 0.7)) AS s FROM x),
g AS (SELECT claim, bool_or(anchored) AS anchored, bool_or(s) AS good, bool_or(NOT s AND ac >= 0.9) AS veto, bool_or(NOT sup AND ac >= 0.2) AS against, bool_and(sup OR (a > 0.4 AND ac < 0.2)) AS whole, bool_or(sup OR a >= 0.7) AS strong FROM y GROUP BY claim),
f AS (SELECT CASE WHEN NOT anchored THEN CASE WHEN against THEN 'contradiction' ELSE 'unverified' END WHEN good THEN CASE WHEN veto THEN 'contradiction' ELSE 'verified' END WHEN against THEN 'contradiction' ELSE 'unverified' END AS p,
  CASE WHEN against THEN 'contradiction' WHEN anchored AND (whole OR strong) THEN 'verified' ELSE 'unverified' END AS q FROM g)
SELECT p || ' -> ' || q AS change, count(*) AS n FROM f WHERE p <> q GROUP BY 1""")
def verifier_flips(spark, sf):
    """Claims whose status two rules see differently."""
    from ..config import Rules
    from ..operators import claims as C

    x = _judged(spark, sf).select(F.floor(F.col("vec_id") / 3).alias("claim"), F.col("a").alias("e"), F.col("ac").alias("c"), "anchored", ((F.col("a") >= 0.75) & (F.col("ac") < 0.05)).alias("supported"))
    return N.flips(C.decide_support_first(x, Rules(), "claim"), C.decide_strict(x, Rules(), "claim"), ["claim"])


@query("""SELECT a.label, a.vec_id, a.a, b.b FROM (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS a FROM embeddings WHERE vec_id % 5 <> 0) a JOIN (SELECT label, vec_id, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings WHERE vec_id % 2 = 0) b USING (label, vec_id)""")
def shared_pool(spark, sf):
    """Candidates that two rerankers scored, without headings."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("vec_id") % 5 == 0).alias("heading"))
    return N.shared_pool(e.withColumnRenamed("x", "s"), e.where("vec_id % 2 = 0").withColumnRenamed("y", "s"), ["label", "vec_id"], "s", "heading")


@query(f"""WITH {_LOG}, a AS (SELECT doc_id, lang AS text, refused, n_chars / 100 AS s FROM log), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE lang END AS text, refused, n_chars / 100 + doc_id % 11 AS s FROM log WHERE doc_id % 13 <> 0),
j AS (SELECT a.doc_id, a.text AS t1, b.text AS t2, a.s AS s1, b.s AS s2, a.refused AS r1, b.refused AS r2 FROM a FULL JOIN b ON a.doc_id = b.doc_id), e AS (SELECT round(s2 - s1, 9) AS x, row_number() OVER (ORDER BY round(s2 - s1, 9)) - 1 AS r, count(*) OVER () AS n FROM j WHERE s2 IS NOT NULL)
SELECT count(*) FILTER (s2 IS NOT NULL) AS shared, count(*) FILTER (s2 IS NULL) = 0 AS same_cases, count(*) FILTER (t1 = t2) AS same_text, count(*) FILTER (t1 = t2 AND r1 = r2 AND doc_id % 4 = 0) AS controls_unchanged, count(*) FILTER (s2 IS NOT NULL AND doc_id % 4 = 0) AS controls,
  (SELECT round(max(x), 6) FROM e) AS extra_most, (SELECT round(x, 6) FROM e WHERE r = n // 2) AS extra_median FROM j""")
def run_differences(spark, sf):
    """Two runs beside each other: texts, controls, extra time."""
    log = _log(spark, sf)
    a = log.select("doc_id", F.col("lang").alias("text"), "refused", (F.col("n_chars") / 100).alias("seconds"))
    b = log.where("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("lang")).alias("text"), "refused", (F.col("n_chars") / 100 + F.col("doc_id") % 11).alias("seconds"))
    return N.run_differences(a, b, "doc_id", log.where("doc_id % 4 = 0"))


@query(f"""WITH {_CASES} SELECT lang, CASE WHEN doc_id % 5 <> 1 THEN 'no translation' WHEN best < 0.3 THEN 'gate refused' WHEN NOT refused THEN 'published' ELSE 'refused' END AS stage, count(*) AS n FROM cases GROUP BY ALL""")
def stage_outcomes(spark, sf):
    """How far translated questions came."""
    c = _cases(spark, sf).select("lang", F.when(F.col("doc_id") % 5 == 1, "q").alias("translated"), (F.col("best") >= 0.3).alias("gate_passed"), (~F.col("refused")).alias("published"))
    return N.stage_outcomes(c, "lang")


@query(r"""WITH x AS (SELECT conv_id, turn, role, trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ё', 'е'), '\s+', ' ', 'g')) AS t, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, split_part(text, ' ', 1) AS w FROM conversations),
f AS (SELECT *, [w, coalesce(split_part(nx, ' ', 2), 'zz')] AS facts FROM x), s AS (SELECT role, len(list_filter(facts, lambda v: contains(t, trim(regexp_replace(replace(replace(lower(v), 'ß', 'ss'), 'ё', 'е'), '\s+', ' ', 'g'))))) / 2 AS s FROM f)
SELECT role, count(*) AS cases, round(avg(s), 6) AS share, count(*) FILTER (s = 1) AS complete FROM s GROUP BY role""")
def complete_answers(spark, sf):
    """Shares of the facts that turns have: their own first word and the second one of the next turn."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    one = lambda c, k: F.split_part(c, F.lit(" "), F.lit(k))
    x = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.array(one("text", 1), F.coalesce(one(F.lead("text").over(w), 2), F.lit("zz"))).alias("facts"))
    return N.complete_answers(x, "turn", "text", "facts", "role")


_P = "round(CASE WHEN {0} + {1} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({0}, {1}) + 1), lambda i: exp(lgamma({0} + {1} + 1) - lgamma(i + 1) - lgamma({0} + {1} - i + 1) - ({0} + {1}) * ln(2))))) END, 6)"


@query(f"""WITH {_LOG}, x AS (SELECT count(*) FILTER (correct AND NOT base_correct) AS gained, count(*) FILTER (base_correct AND NOT correct) AS lost, count(*) FILTER (coalesce(hallucination, false) AND n_chars < 700) AS invented, count(*) FILTER (NOT coalesce(hallucination, false) AND n_chars >= 700) AS corrected FROM log)
SELECT *, {_P.format('gained', 'lost')} AS p, {_P.format('invented', 'corrected')} AS p_invented FROM x""")
def second_generator(spark, sf):
    """Gained and lost cases, and inventions that came and went."""
    return N.second_run(_log(spark, sf).withColumn("base_hallucination", F.col("n_chars") >= 700))


@query(f"""WITH r AS ({_RULES}), c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (r1 = good)::DOUBLE AS o, count(*) FILTER (r1)::DOUBLE AS a, count(*) FILTER (good)::DOUBLE AS b, count(*) FILTER (r1 AND NOT good) AS too_kind, count(*) FILTER (NOT r1 AND good) AS too_strict, list_sort(list(doc_id) FILTER (r1 <> good)) AS cases FROM r)
SELECT CAST(n AS BIGINT) AS n, round(o / n, 6) AS agreement, round((o / n - (a * b + (n - a) * (n - b)) / (n * n)) / (1 - (a * b + (n - a) * (n - b)) / (n * n)), 6) AS kappa, too_kind, too_strict, cases FROM c""")
def scorer_audit(spark, sf):
    """A rule's verdicts beside the labels."""
    return N.audit(_rules(spark, sf), "doc_id", "r1", "good")


@query(f"""WITH r AS ({_RULES}), s AS (SELECT k AS step, (SELECT count(*) FILTER ((n_chars >= 200 * k) = good) FROM r) AS gain, (SELECT count(*) FILTER (n_chars < 200 * k) FROM r) AS caught FROM (SELECT CAST(unnest(range(0, 8)) AS INT) AS k)), d AS (SELECT *, gain - lag(gain) OVER (ORDER BY step) AS d FROM s)
SELECT (SELECT step FROM d WHERE d IS NOT NULL ORDER BY d DESC, step LIMIT 1) AS best_step, (SELECT max(d) FROM d) AS gain, (SELECT step FROM d ORDER BY caught, step LIMIT 1) AS lowest_step, (SELECT min(caught) FROM d) AS "catch\"""")
def ladder_extremes(spark, sf):
    """The step of a ladder that gained most, and the one that caught least."""
    r = _rules(spark, sf).withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(8)))))
    n = F.col("n_chars")
    s = r.groupBy("step").agg(F.count_if((n >= 200 * F.col("step")) == F.col("good")).alias("gained"), F.count_if(n < 200 * F.col("step")).alias("caught"))
    return N.ladder_extremes(s, "step", "gained", "caught")


@query(f"""WITH {_CASES}, k AS (SELECT *, CASE WHEN toxic THEN 'Adversarial' WHEN good THEN 'Positive' ELSE 'Negative' END AS kind FROM cases)
SELECT lang, count(*) AS cases, count(*) FILTER (kind = 'Positive' AND NOT refused) AS answered, count(*) FILTER (kind = 'Negative' AND refused) AS refused_rightly, count(*) FILTER (kind = 'Adversarial' AND r1) AS corrected, count(*) FILTER (reason = 'llm_refusal') AS by_model FROM k GROUP BY lang""")
def profile_report(spark, sf):
    """An A/B run by language: answered, rightly refused, corrected, and refusals by reason."""
    kind = F.when(F.col("toxic"), "Adversarial").when(F.col("good"), "Positive").otherwise("Negative")
    x = N.profile_report(_cases(spark, sf).select("lang", kind.alias("kind"), "refused", F.col("r1").alias("correct"), "reason"), "lang")
    return x.select("lang", "cases", "answered", "refused_rightly", "corrected", F.coalesce(F.try_element_at("by_reason", F.lit("llm_refusal")), F.lit(0)).alias("by_model"))


@query(f"WITH {_CASES} SELECT grades[1] AS code, count(*) AS n FROM cases WHERE len(grades) > 0 GROUP BY 1")
def primary_codes(spark, sf):
    """First grades of cases."""
    return N.primary_codes(_cases(spark, sf), "grades")


@query("SELECT label, vec_id // 7 AS place, max(CAST(embedding[1] AS DOUBLE)) AS score, count(*) AS rows FROM embeddings GROUP BY ALL")
def collapsed_scores(spark, sf):
    """Scores of one key as one row."""
    x = table(spark, sf, "embeddings").select("label", F.floor(F.col("vec_id") / 7).alias("place"), F.col("embedding")[0].cast("double").alias("score"))
    return N.collapsed(x, "label", "place")


@query("""WITH p AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT * FROM p ORDER BY sha1('t' || conv_id), conv_id LIMIT 30)
SELECT count(*) AS cases, CAST(sum(n) AS BIGINT) AS pairs, round(avg(n), 6) AS mean, median(n) AS median FROM s""")
def pair_throughput(spark, sf):
    """Pairs of a sample of cases."""
    return N.throughput(table(spark, sf, "conversations"), "conv_id", 30)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE lang = 'en' AND r <= 3 OR lang = 'fr' AND r <= 2""")
def determinism_sample(spark, sf):
    """Some documents of two languages, by the hash of their ids."""
    return N.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", {"en": 3, "fr": 2})


_AN = r"trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'ё', 'е'), '\s+', ' ', 'g'))"


@query(rf"""WITH x AS (SELECT conv_id * 1000 + turn AS id, conv_id, text, trim(split_part(text, ' ', 2), ' "«»') AS a FROM conversations), o AS (SELECT DISTINCT conv_id, a AS other FROM x),
p AS (SELECT x.id, x.text, x.a, o.other, row_number() OVER (PARTITION BY x.id ORDER BY abs(length(other) - length(a)), other) AS r FROM x JOIN o USING (conv_id)
  WHERE length(a) >= 2 AND regexp_matches(a, '[0-9]') = regexp_matches(other, '[0-9]') AND {_AN.format('a')} <> '' AND {_AN.format('other')} <> '' AND NOT contains({_AN.format('a')}, {_AN.format('other')}) AND NOT contains({_AN.format('other')}, {_AN.format('a')})),
q AS (SELECT *, strpos(lower(text), lower(a)) AS p FROM p WHERE r = 1) SELECT id, other, substr(text, 1, p - 1) || other || substr(text, p + length(a)) AS text FROM q WHERE p > 0 AND NOT contains({_AN.format('text')}, {_AN.format('other')})""")
def answer_swaps(spark, sf):
    """Turns with their second word replaced by another turn's."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "text", F.split_part("text", F.lit(" "), F.lit(2)).alias("a"))
    return N.answer_swaps(c, "id", "conv_id", "text", "a")


@query(f"""WITH {_LOG}, q AS (SELECT CASE WHEN base_correct AND correct THEN 'A' WHEN base_correct THEN 'B' WHEN correct THEN 'C' ELSE 'D' END AS quadrant, CASE WHEN refused AND base_refused THEN 'both refuse' WHEN refused THEN 'withheld' WHEN hallucination THEN 'invented' ELSE 'other' END AS cause, doc_id FROM log),
n AS (SELECT quadrant, cause, count(*) AS n, min(doc_id) AS first FROM q GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY n DESC, first) = 1 AS main FROM n""")
def root_causes(spark, sf):
    """Quadrants of draft and answer by cause, and the most common cause of each, the earliest on ties."""
    q = F.when(F.col("base_correct") & F.col("correct"), "A").when(F.col("base_correct"), "B").when(F.col("correct"), "C").otherwise("D")
    cause = F.when(F.col("refused") & F.col("base_refused"), "both refuse").when(F.col("refused"), "withheld").when(F.col("hallucination"), "invented").otherwise("other")
    return X.root_causes(_log(spark, sf).withColumns({"quadrant": q, "cause": cause}), "quadrant", "cause", "doc_id")


@query("""SELECT metric, event_type, max(v) AS peak, round(avg(v), 6) AS mean FROM (SELECT event_type, unnest(['value', 'k']) AS metric, unnest([value, CAST(json_extract(props, '$.k') AS DOUBLE)]) AS v FROM events) GROUP BY ALL""")
def resource_peaks(spark, sf):
    """Peak and mean of two metrics of events."""
    x = table(spark, sf, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return E.peaks(x, ["value", "k"], "event_type")


_DEC = "d AS (SELECT CASE label % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS label, ae AS e, ac AS c, CASE WHEN ac >= 0.2 THEN 'contradiction' WHEN ae > 0.4 THEN 'verified' ELSE 'unverified' END AS status FROM (SELECT n.*, label FROM n JOIN embeddings USING (vec_id)))"
_SHARES = """count(*) AS n, round(count(*) FILTER (label <> 'entailment' AND status <> 'verified') / nullif(count(*) FILTER (label <> 'entailment'), 0), 6) AS catch_rate,
 round(count(*) FILTER (label = 'contradiction' AND status <> 'verified') / nullif(count(*) FILTER (label = 'contradiction'), 0), 6) AS contradiction_catch_rate, round(count(*) FILTER (label = 'neutral' AND status <> 'verified') / nullif(count(*) FILTER (label = 'neutral'), 0), 6) AS neutral_catch_rate,
 round(count(*) FILTER (label = 'contradiction' AND status = 'contradiction') / nullif(count(*) FILTER (label = 'contradiction'), 0), 6) AS named_contradiction, round(count(*) FILTER (label = 'entailment' AND status <> 'verified') / nullif(count(*) FILTER (label = 'entailment'), 0), 6) AS false_rejection,
 round(count(*) FILTER (status = CASE label WHEN 'entailment' THEN 'verified' WHEN 'neutral' THEN 'unverified' ELSE 'contradiction' END) / count(*), 6) AS agreement"""


def _pairs(spark, sf):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    m = F.col("label") % 3
    return table(spark, sf, "embeddings").select("vec_id", F.when(m == 0, "entailment").when(m == 1, "neutral").otherwise("contradiction").alias("label"), (e(0) * 2).alias("e"), e(1).alias("c"))


@query(f"WITH {_NLI}, {_DEC} SELECT {_SHARES} FROM d")
def decision_metrics(spark, sf):
    """What the rule for one source catches and rejects."""
    from ..config import Rules
    from ..operators import claims as C

    x = _pairs(spark, sf).withColumn("status", C.single_source_status(F.col("e"), F.col("c"), Rules(strong=1e9)))
    return x.agg(*E.decision_shares(F.col("label"), F.col("status")))


@query(f"WITH {_NLI}, {_DEC}, l AS (SELECT unnest(['entailment', 'neutral', 'contradiction']) AS label), s AS (SELECT unnest(['verified', 'unverified', 'contradiction']) AS status) SELECT l.label, s.status, count(d.e) AS n FROM l CROSS JOIN s LEFT JOIN d ON d.label = l.label AND d.status = s.status GROUP BY ALL")
def status_matrix(spark, sf):
    """Status by gold label."""
    from ..config import Rules
    from ..operators import claims as C

    return E.status_matrix(_pairs(spark, sf).withColumn("status", C.single_source_status(F.col("e"), F.col("c"), Rules(strong=1e9))), "label", "status")


@query(f"""WITH {_NLI}, {_DEC}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS entailment), u AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS contradiction),
g AS (SELECT entailment, contradiction, label, CASE WHEN c >= contradiction THEN 'contradiction' WHEN e > entailment OR e >= 0.35 THEN 'verified' ELSE 'unverified' END AS status FROM d, t, u)
SELECT entailment, contradiction, round(count(*) FILTER (label <> 'entailment' AND status <> 'verified') / count(*) FILTER (label <> 'entailment'), 6) AS catch_rate, round(count(*) FILTER (label = 'entailment' AND status <> 'verified') / count(*) FILTER (label = 'entailment'), 6) AS false_rejection FROM g GROUP BY ALL""")
def two_axis_sweep(spark, sf):
    """The same over a grid of two thresholds."""
    return E.two_axis_sweep(_pairs(spark, sf), "e", "c", "label", [0.1, 0.2, 0.3, 0.4], [0.05, 0.1, 0.2], 0.35)


@query(f"""WITH r AS ({_RULES}), x AS (SELECT CASE WHEN toxic THEN 'toxic' WHEN good THEN 'good' ELSE 'poor' END AS gold, CASE WHEN NOT r1 THEN 'poor' WHEN r2 THEN 'good' ELSE 'toxic' END AS said FROM r),
l AS (SELECT unnest(['good', 'poor', 'toxic', 'none']) AS label), c AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (gold = label AND said = label) AS hits, count(*) FILTER (said = label) AS saids FROM l, x GROUP BY label),
m AS (SELECT *, coalesce(hits / nullif(saids, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM c)
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)) FILTER (support > 0), 6) AS macro_f1 FROM m""")
def macro_report(spark, sf):
    """Accuracy and macro-F1 of three classes, one more never occurring."""
    x = _rules(spark, sf).select(F.when(F.col("toxic"), "toxic").when(F.col("good"), "good").otherwise("poor").alias("gold"), F.when(~F.col("r1"), "poor").when(F.col("r2"), "good").otherwise("toxic").alias("said"))
    return E.macro_report(x, "gold", "said", ["good", "poor", "toxic", "none"])


@query("""WITH m AS (SELECT lang, CASE WHEN doc_id % 3 <> 0 THEN n_chars / 10 END AS a, CASE WHEN doc_id % 5 = 0 THEN n_chars / 7 END AS b FROM documents), u AS (SELECT lang, unnest(['a', 'b']) AS metric, unnest([a, b]) AS v FROM m)
SELECT lang, metric, round(avg(v), 6) AS mean, count(v) AS defined, count(*) - count(v) AS undefined FROM u GROUP BY ALL""")
def defined_means(spark, sf):
    """Means of metrics that aren't defined everywhere."""
    d = table(spark, sf, "documents").select("lang", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") / 10).alias("a"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") / 7).alias("b"))
    return E.defined_means(d, ["a", "b"], "lang")


@query()
def bootstrap_difference(spark, sf):
    """Two rules' difference with a bootstrap interval."""
    r = _rules(spark, sf)
    return E.bootstrap_difference(r.select("doc_id", (F.col("r2") == F.col("good")).alias("x"), (F.col("r1") == F.col("good")).alias("y")), "doc_id", "x", "y", 200)


# Judgments and ranks.

_JUDGE_SQL = """src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
jd AS (SELECT item_id AS query, source AS document_id, NULL::BIGINT AS chunk_id, 1 AS grade FROM benchmark JOIN src ON item_id % n = i UNION ALL SELECT item_id, source, doc_id, 3 FROM gold JOIN documents USING (doc_id)),
grades AS (SELECT query, d.doc_id AS id, max(grade) AS grade FROM jd JOIN documents d ON d.source = jd.document_id AND (chunk_id IS NULL OR chunk_id = d.doc_id) GROUP BY ALL)"""


def _judgments(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    names = docs.select("source").distinct()
    n = names.count()
    from pyspark.sql.window import Window

    # The sources of a corpus, a row each.
    src = names.select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("i"))
    whole = bench.join(F.broadcast(src), F.col("item_id") % n == F.col("i")).select(F.col("item_id").alias("query"), F.col("source").alias("document_id"), F.lit(None).cast("long").alias("chunk_id"), F.lit(1).alias("grade"))
    gold = R.containing(docs, bench, "doc_id", "item_id", "text").join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    own = gold.select(F.col("quote").alias("query"), F.col("source").alias("document_id"), F.col("id").alias("chunk_id"), F.lit(3).alias("grade"))
    return R.resolved_judgments(whole.unionByName(own), docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id")))


@query(f"WITH {_GOLD}, {_JUDGE_SQL} SELECT query AS item_id, id AS doc_id, grade FROM grades")
def resolved_judgments(spark, sf):
    """Grades of documents from judgments of documents and of whole sources."""
    return _judgments(spark, sf).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "grade")


@query(f"""WITH {BM25_SQL}, {_GOLD}, {_JUDGE_SQL}, x AS (SELECT g.query, grade, rank FROM grades g LEFT JOIN sparse s ON s.query = g.query AND s.id = g.id AND rank <= 10),
i AS (SELECT query, list_sum(list_transform(list(pow(2, grade) - 1 ORDER BY grade DESC)[1:10], lambda v, i: v / log2(i + 1))) AS ideal FROM grades GROUP BY query)
SELECT query AS item_id, CAST(count(rank) > 0 AS DOUBLE) AS hit, round(coalesce(1 / min(rank), 0), 6) AS mrr, round(coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)), 0) / any_value(ideal), 6) AS ndcg FROM x JOIN i USING (query) GROUP BY query""")
def graded_metrics(spark, sf):
    """Hit, reciprocal rank and nDCG of the lexical ranking by graded judgments."""
    ranked = R.bm25(_index(spark, sf), R.query_terms(table(spark, sf, "benchmark"), "item_id", "text"))
    return R.graded_metrics(ranked, _judgments(spark, sf), 10).withColumnRenamed("query", "item_id")


@query(f"""WITH {BM25_SQL}, {_GOLD}, u AS (SELECT item_id, doc_id % 2 AS unit, min(rank) AS first FROM gold LEFT JOIN sparse ON query = item_id AND id = doc_id GROUP BY ALL)
SELECT item_id, count(*) AS units, {', '.join(f"round(count(*) FILTER (first <= {k}) / count(*), 6) AS recall_{k}, CAST(count(*) FILTER (first <= {k}) > 0 AS DOUBLE) AS hit_{k}, round(coalesce(sum(1 / log2(first + 1)) FILTER (first <= {k}), 0) / list_sum(list_transform(range(1, least(count(*), {k}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}" for k in (1, 3, 5, 10))},
 round(coalesce(1 / min(first) FILTER (first <= 10), 0), 6) AS mrr_10 FROM u GROUP BY item_id""")
def unit_metrics(spark, sf):
    """The same by units of evidence: documents with even and with odd numbers."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    gold = R.containing(docs, bench, "doc_id", "item_id", "text").withColumnRenamed("quote", "query")
    units = gold.groupBy("query", (F.col("id") % 2).alias("unit")).agg(F.collect_list("id").alias("ids"))
    return R.unit_metrics(R.bm25(_index(spark, sf), R.query_terms(bench, "item_id", "text")), units).withColumnRenamed("query", "item_id")


@query(f"""WITH {BM25_SQL}, {_GOLD}, r AS (SELECT item_id, doc_id AS run, unnest([doc_id, doc_id + 1]) AS id FROM gold), p AS (SELECT r.item_id, run, CASE WHEN count(rank) = count(*) THEN max(rank) END AS rank FROM r LEFT JOIN sparse s ON s.query = r.item_id AND s.id = r.id GROUP BY ALL)
SELECT item_id, min(rank) AS rank FROM p GROUP BY item_id""")
def run_ranks(spark, sf):
    """Ranks of runs of two neighbouring documents, found where the last of them is."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    gold = R.containing(docs, bench, "doc_id", "item_id", "text")
    runs = gold.select(F.col("quote").alias("query"), F.lit(0).alias("quote"), F.col("id").alias("run"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("id"))
    ranked = R.bm25(_index(spark, sf), R.query_terms(bench, "item_id", "text"))
    return R.run_ranks(ranked, runs).select(F.col("query").alias("item_id"), "rank")


@query(f"""WITH {BM25_SQL}, b AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM sparse) SELECT query AS item_id, any_value(best) < 20 AS gated, count(*) FILTER (rank <= 10 AND (score >= greatest(20, 0.8 * best) OR rank = 1)) AS kept FROM b GROUP BY query""")
def adaptive_context(spark, sf):
    """How many of the first ten are near the best one."""
    ranked = R.bm25(_index(spark, sf), R.query_terms(table(spark, sf, "benchmark"), "item_id", "text"))
    x = R.adaptive_context(ranked, "score", 20.0, 10, 0.8)
    return x.groupBy(F.col("query").alias("item_id")).agg(F.first("gated").alias("gated"), F.count_if("kept").alias("kept"))


@query(f"""WITH {BM25_SQL}, {_GOLD}, g AS (SELECT item_id, max(score) AS best FROM gold JOIN sparse ON query = item_id AND id = doc_id GROUP BY 1), x AS (SELECT item_id % 2 = 0 AS refused, best FROM g)
SELECT refused, count(*) AS n, max(best) AS most, median(best) AS median FROM x GROUP BY refused""")
def gold_scores(spark, sf):
    """Best scores of gold documents."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    gold = R.containing(docs, bench, "doc_id", "item_id", "text").withColumnRenamed("quote", "query")
    best = R.bm25(_index(spark, sf), R.query_terms(bench, "item_id", "text")).join(gold, ["query", "id"]).groupBy("query").agg(F.max("score").alias("best"))
    return best.groupBy((F.col("query") % 2 == 0).alias("refused")).agg(F.count("*").alias("n"), F.max("best").alias("most"), F.median("best").alias("median"))


@query(f"""WITH {BM25_SQL}, {_GOLD}, p AS (SELECT item_id AS query, CASE WHEN item_id % 3 <> 0 THEN (item_id + 1) % (SELECT max(item_id) + 1 FROM benchmark) END AS translated FROM benchmark), b AS (SELECT query, max(score) >= 25 AS gate FROM sparse GROUP BY 1),
f AS (SELECT s.query, min(rank) AS rank FROM sparse s JOIN gold g ON g.item_id = s.query AND g.doc_id = s.id GROUP BY 1), a AS (SELECT p.query, min(rank) AS rank FROM p JOIN gold g ON g.item_id = p.query JOIN sparse s ON s.query = p.translated AND s.id = g.doc_id GROUP BY 1)
SELECT p.query AS item_id, x.gate AS gate_before, y.gate AS gate_after, f.rank AS rank_before, a.rank AS rank_after FROM p LEFT JOIN b x ON x.query = p.query LEFT JOIN b y ON y.query = p.translated LEFT JOIN f ON f.query = p.query LEFT JOIN a ON a.query = p.query""")
def translated_effect(spark, sf):
    """Gate and gold rank before and after a question is put otherwise."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    n = bench.agg(F.max("item_id")).first()[0] + 1
    pairs = bench.select(F.col("item_id").alias("query"), F.when(F.col("item_id") % 3 != 0, (F.col("item_id") + 1) % n).alias("translated"))
    ranked = R.bm25(_index(spark, sf), R.query_terms(bench, "item_id", "text")).withColumnRenamed("score", "rerank")
    gold = R.containing(docs, bench, "doc_id", "item_id", "text").withColumnRenamed("quote", "query")
    return N.translated_effect(ranked, ranked, gold, pairs, 25.0).withColumnRenamed("query", "item_id")
