"""Logs of runs: who replaces whom, what a setting would have changed, and how two runs differ.

A log has one row for each attempt or case; what the passes of a case do in turn is written as ordered conditions and
folds over a case's few attempts, never as a loop over cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as S
from ..functions import text as T
from .evaluate import upper_median

#: Refusals that a second thought can't mend, and those that a translated question may.
EXEMPT = ("relevance_threshold_not_met", "context_budget_exceeded")
TRANSLATED = ("relevance_threshold_not_met", "llm_refusal")
CONFLICTS = ("contradicted", "ambiguous", "partially_supported")


# What a case asks for.


def recovery_due(reason: Column, best: Column, least: float) -> Column:
    """An answer refused by the model although a source is relevant."""
    return F.coalesce((reason == "llm_refusal") & (best >= least), F.lit(False))


def think_retry(reason: Column, mode: str) -> Column:
    """Whether a refused answer is thought over: after the model's refusals, or after any but of too little room."""
    if mode == "llm_refusal":
        return F.coalesce(reason == "llm_refusal", F.lit(False))
    if mode == "refusal":
        return reason.isNotNull() & (reason != "context_budget_exceeded")
    return F.lit(False)


def trimmed(refused: Column, statuses: Column) -> Column:
    """Published, but with a claim held back."""
    return ~refused & F.exists(statuses, lambda s: s != "verified")


def fully_verified(refused: Column, statuses: Column) -> Column:
    return ~refused & F.forall(statuses, lambda s: s == "verified")


def partly_answered(refused: Column, statuses: Column, claims: Column) -> Column:
    """Published with a claim held back, or with a statement that the sources lack something."""
    return ~refused & (F.exists(statuses, lambda s: s != "verified") | F.exists(claims, T.is_absence))


def translation_due(reason: Column, question: Column, sources: Column) -> Column:
    """The language that a refused question should be put in: that of its sources, if it is another one; else null."""
    asked, target = T.text_script(question), T.text_script(sources)
    return F.when(reason.isin(*TRANSLATED) & (asked != target), target)


def compound(expected: Column, facts: Column) -> Column:
    """A question whose answer has two facts or more."""
    return (expected == "answer") & (F.coalesce(F.size(facts), F.lit(0)) >= 2)


def not_contradicted(c: Column, most: float = 0.3) -> Column:
    return F.coalesce(c <= most, F.lit(False))


def same_kind_of_value(a: Column, b: Column) -> Column:
    """Both with a digit, or both without."""
    return a.rlike(r"\d") == b.rlike(r"\d")


def routes(log: DataFrame, key: str, thresholds: dict[str, list[float]] | None = None) -> DataFrame:
    """(key, route, threshold, routed) of cases (refused, reason, attempts, best, least_confidence, grades, question): which of
    them each route sends to a second pass."""
    t = {"withheld_or_low_retrieval": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5], "withheld_or_low_confidence": [0.4, 0.5, 0.6, 0.7, 0.8, 0.9], "adaptive": [0.4, 0.5, 0.6, 0.7, 0.8]} | (thresholds or {})
    withheld = F.col("refused") & ~F.coalesce(F.col("reason").isin(*EXEMPT), F.lit(False)) & F.col("reason").isNotNull()
    shown, best, least = ~F.col("refused"), F.coalesce("best", F.lit(0.0)), F.coalesce("least_confidence", F.lit(0.0))
    conflict = F.arrays_overlap("grades", F.array(*map(F.lit, CONFLICTS)))
    found = {
        ("never", None): F.lit(False), ("first_refusal", None): F.coalesce((F.col("reason") == "llm_refusal") & (F.col("attempts") == 1), F.lit(False)),
        ("withheld", None): withheld, ("withheld_or_conflict", None): withheld | (shown & conflict),
        ("withheld_or_several_parts", None): withheld | (shown & T.asks_several("question")), ("always", None): F.lit(True),
    }
    found |= {("withheld_or_low_retrieval", x): withheld | (shown & (best < x)) for x in t["withheld_or_low_retrieval"]}
    found |= {("withheld_or_low_confidence", x): withheld | (shown & (least < x)) for x in t["withheld_or_low_confidence"]}
    found |= {("adaptive", x): withheld | (shown & (conflict | (least < x) | (best < 0.05))) for x in t["adaptive"]}
    rows = [F.struct(F.lit(n).alias("route"), F.lit(x).cast("double").alias("threshold"), F.coalesce(r, F.lit(False)).alias("routed")) for (n, x), r in found.items()]
    return log.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def chosen(base_refused: Column, think_refused: Column, base_confidence: Column, think_confidence: Column, routed: Column, policy: str) -> Column:
    """Which of two results of a routed case counts: 'base' or 'think'.  A published answer is never given up for a refusal;
    among two published ones the second counts, or (confidence) the one whose weakest claim is stronger."""
    better = F.lit(True) if policy == "replace" else F.coalesce(think_confidence, F.lit(0.0)) >= F.coalesce(base_confidence, F.lit(0.0))
    think = F.when(base_refused, True).when(think_refused, False).otherwise(better)
    return F.when(routed & think, "think").otherwise("base")


# Attempts of cases.


def claim_summary(claims: DataFrame, key: str) -> DataFrame:
    """(key, least_confidence, grades): the weakest fact of a case and the grades of its facts."""
    facts = claims.where("kind = 'fact'")
    return facts.groupBy(key).agg(F.min("confidence").alias("least_confidence"), F.array_sort(F.collect_set("grade")).alias("grades"))


def attempt_roles(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Adds role from (thinking, recovery): drafts, thoughts and their repairs by turns within a run of one mode."""
    w = Window.partitionBy(key).orderBy(order)
    mode = F.when(F.col("recovery"), "recovery").when(F.col("thinking"), "think").otherwise("draft")
    x = attempts.withColumn("__m", mode)
    x = x.withColumn("__g", F.sum(F.when(F.col("__m") == F.lag("__m").over(w), 0).otherwise(1)).over(w))
    odd = F.row_number().over(Window.partitionBy(key, "__g").orderBy(order)) % 2 == 1
    role = F.when(F.col("__m") == "recovery", "recovery").when(odd, F.col("__m")).otherwise(F.when(F.col("__m") == "think", "think_repair").otherwise("repair"))
    return x.withColumn("role", role).drop("__m", "__g")


def replay(attempts: DataFrame, cases: DataFrame, key: str, order: str, mode: str = "refusal", repairs: int = 2, least: float = 0.5, samples: int = 2) -> DataFrame:
    """(key, path, final, reason, missing): what a case's logged attempts (role, refused, reason, claims) come to under other
    settings.

    A refused draft with claims is repaired up to ``repairs`` times; a refusal that ``mode`` names is thought over, and
    what that gives counts; a refusal of the model with a relevant source (``best`` of ``cases``) is sampled again until a
    sample is published.  ``missing`` is the first role of which the log has too few attempts.
    """
    a = F.struct(order, "role", "refused", "reason", "claims")
    g = attempts.groupBy(key).agg(F.array_sort(F.collect_list(a)).alias("log")).join(cases.select(key, F.col("best").alias("best")), key, "left")
    of = lambda role: F.filter("log", lambda x: x["role"] == role)

    def draft(first: str, repair: str) -> tuple[Column, Column, Column]:
        """How many repairs are taken, the result, and whether one lacks."""
        start = F.get(of(first), F.lit(0))
        tries = F.slice(of(repair), 1, repairs)
        mendable = lambda x: x["refused"] & (x["claims"] > 0)
        used = F.aggregate(
            F.concat(F.array(start), tries), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda s, x: F.struct((s["n"] + F.when(s["on"], 1).otherwise(0)).alias("n"), (s["on"] & mendable(x)).alias("on")),
        )
        n = F.when(start.isNotNull(), used["n"]).otherwise(0)
        last = F.get(F.concat(F.array(start), tries), n - 1)
        lacks = F.when(start.isNull(), F.lit(first)).when(used["on"] & (n < repairs + 1), F.lit(repair))
        return n, last, lacks

    n1, r1, m1 = draft("draft", "repair")
    g = g.withColumns({"n1": n1, "r1": r1, "m1": m1})
    n2, r2, m2 = draft("think", "think_repair")
    thinks = F.coalesce(think_retry(F.col("r1.reason"), mode), F.lit(False))
    g = g.withColumns({"n2": F.when(thinks, n2).otherwise(0), "r2": F.when(thinks, r2), "m2": F.when(thinks, m2)})
    g = g.withColumn("r", F.coalesce("r2", "r1"))
    due = recovery_due(F.col("r.reason"), F.coalesce("best", F.lit(0.0)), least)
    drawn = F.slice(of("recovery"), 1, samples)
    hit = F.array_position(F.transform(drawn, lambda x: x["refused"]), False).cast("int")
    n3 = F.when(hit > 0, hit).otherwise(F.size(drawn))
    g = g.withColumns({"n3": F.when(due, n3).otherwise(0), "won": F.when(due & (hit > 0), F.get(drawn, hit - 1)), "m3": F.when(due & (hit == 0) & (F.size(drawn) < samples), F.lit("recovery"))})
    g = g.withColumn("r", F.coalesce("won", "r"))
    steps = lambda n, first, repair: F.when(n > 0, F.concat(F.array(F.lit(first)), F.array_repeat(F.lit(repair), (n - 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    path = F.concat(steps(F.col("n1"), "draft", "repair"), steps(F.col("n2"), "think", "think_repair"), F.array_repeat(F.lit("recovery"), F.col("n3").cast("int")))
    return g.select(key, path.alias("path"), F.col(f"r.{order}").alias("final"), F.col("r.reason").alias("reason"), F.coalesce("m1", "m2", "m3").alias("missing"))


def replay_agreement(replayed: DataFrame, log: DataFrame, key: str, final: str = "final") -> DataFrame:
    """One row: cases, replayed whole, and of them those with the logged result and the logged publication."""
    x = replayed.select(key, F.col("final"), F.col("reason"), F.col("missing")).join(log.select(key, F.col(final).alias("logged"), F.col("reason").alias("why")), key)
    whole = F.col("missing").isNull()
    return x.agg(
        F.count("*").alias("cases"), F.count_if(whole).alias("whole"), F.count_if(whole & F.col("final").eqNullSafe(F.col("logged"))).alias("same_result"),
        F.count_if(whole & (F.col("reason").isNull() == F.col("why").isNull())).alias("same_publication"),
    )


def think_on_trim(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Cases (key) with a thought that came right after a published attempt."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.row_number().over(Window.partitionBy(key, "role").orderBy(order))
    x = attempts.withColumns({"__before": F.lag("published").over(w), "__first": first})
    return x.where("role = 'think' and __first = 1 and __before").select(key).distinct()


def recovery_population(logs: list[DataFrame], key: str, least: float = 0.05) -> DataFrame:
    """Cases (key) that end, in any of several logs (reason, best), in a refusal of the model with a relevant source."""
    out = None
    for log in logs:
        x = log.where(recovery_due(F.col("reason"), F.col("best"), least)).select(key)
        out = x if out is None else out.union(x)
    return out.repartition(key).distinct()


def top_sources(sources: DataFrame, key: str, score: str, order: str, n: int = 2) -> DataFrame:
    """The n best sources of each case, earlier ones first on ties."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), order))
    return sources.withColumn("place", r).where(F.col("place") <= n)


def candidate_run(cases: DataFrame, key: str, routed: Column, threshold: float | None = None) -> DataFrame:
    """(key, config, published, calls, ms) of cases with the results of the base, thinking, revising and recovering passes
    (base_published, base_reason, base_ms, think_published, think_reason, think_ms, revise_published, recover_published,
    recover_ms, best): a route sends a case to the thinking pass, a withheld answer may be revised, a refusal recovered."""
    revise = routed & (F.col("base_reason") == "nli_verification_failed") & F.col("revise_reason_known")
    published = F.when(revise, F.col("revise_published")).when(routed, F.col("think_published")).otherwise(F.col("base_published"))
    reason = F.when(revise, F.when(F.col("revise_published").isNull(), "nli_verification_failed")).when(routed, F.col("think_reason")).otherwise(F.col("base_reason"))
    due = recovery_due(reason, F.col("best"), threshold) if threshold is not None else F.lit(False)
    won = due & F.col("recover_published").isNotNull()
    ms = F.col("base_ms") + F.when(routed, F.col("think_ms")).otherwise(0.0) + F.when(due, F.col("recover_ms")).otherwise(0.0)
    return cases.select(
        key, F.when(won | revise | ~routed, "base").otherwise("think").alias("config"), F.when(won, F.col("recover_published")).otherwise(published).alias("published"),
        routed.cast("int").alias("calls"), won.alias("recovered"), ms.alias("ms"),
    )


def revision_key(*parts: str | Column) -> Column:
    """The name of a revision: a hash of its case, configuration, attempt and text."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)))


# Two runs side by side.


def flips(a: DataFrame, b: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """(change, n): claims by ``from -> to`` whose status two variants of a check see differently."""
    x = a.select(*keys, F.col(status).alias("x")).join(b.select(*keys, F.col(status).alias("y")), keys).where("x <> y")
    return x.groupBy(F.concat_ws(" -> ", "x", "y").alias("change")).agg(F.count("*").alias("n"))


def shared_pool(a: DataFrame, b: DataFrame, keys: list[str], score: str, heading: str | None = None) -> DataFrame:
    """Candidates that two rerankers scored, headings left out: keys, a, b."""
    keep = ~F.coalesce(F.col(heading), F.lit(False)) if heading else F.lit(True)
    return a.where(keep).select(*keys, F.col(score).alias("a")).join(b.select(*keys, F.col(score).alias("b")), keys)


def translated_effect(before: DataFrame, after: DataFrame, gold: DataFrame, pairs: DataFrame, gate: float) -> DataFrame:
    """(query, gate_before, gate_after, rank_before, rank_after) of questions and their translations: ``pairs`` (query,
    translated), rankings (query, id, rank, rerank), ``gold`` (query, id).  A question without a translation has nulls."""
    best = lambda r, name: r.groupBy("query").agg((F.max("rerank") >= gate).alias(name))
    found = lambda r, g, name: r.join(g.select("query", "id"), ["query", "id"]).groupBy("query").agg(F.min("rank").alias(name))
    a = pairs.join(best(before, "gate_before"), "query", "left").join(found(before, gold, "rank_before"), "query", "left")
    own = gold.join(pairs, "query").select(F.col("translated").alias("query"), "id")
    hits = found(after, own, "rank_after").withColumnRenamed("query", "translated")
    gates = best(after, "gate_after").withColumnRenamed("query", "translated")
    out = a.join(gates, "translated", "left").join(hits, "translated", "left")
    return out.select("query", "gate_before", "gate_after", "rank_before", "rank_after")


def run_differences(base: DataFrame, other: DataFrame, key: str, controls: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: cases of two runs (key, text, refused, seconds): shared ones, whether the sets are equal, equal texts, unchanged
    controls, and the upper median and the maximum of the extra time."""
    j = base.select(key, F.col("text").alias("t1"), F.col("refused").alias("r1"), F.col(seconds).alias("s1")).join(
        other.select(key, F.col("text").alias("t2"), F.col("refused").alias("r2"), F.col(seconds).alias("s2")), key, "full"
    )
    j = j.join(controls.select(key, F.lit(True).alias("control")), key, "left")
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    same = F.col("t1").eqNullSafe(F.col("t2"))
    extra = j.where(both).select(F.lit(0).alias("g"), (F.col("s2") - F.col("s1")).alias("x"))
    middle = upper_median(extra, "x", "g").select(F.round("upper_median", 6).alias("extra_median"))
    one = j.agg(
        F.count_if(both).alias("shared"), (F.count_if(~both) == 0).alias("same_cases"), F.count_if(both & same).alias("same_text"),
        F.count_if(both & F.col("control") & same & F.col("r1").eqNullSafe(F.col("r2"))).alias("controls_unchanged"), F.count_if(both & F.col("control")).alias("controls"),
    )
    return one.crossJoin(F.broadcast(extra.agg(F.round(F.max("x"), 6).alias("extra_most")))).join(F.broadcast(middle), how="left")


def stage_outcomes(log: DataFrame, *by: str) -> DataFrame:
    """(by, stage, n) of cases (translated, gate_passed, published): how far each came."""
    stage = F.when(F.col("translated").isNull(), "no translation").when(~F.coalesce("gate_passed", F.lit(False)), "gate refused").when(F.col("published"), "published").otherwise("refused")
    return log.groupBy(*by, stage.alias("stage")).agg(F.count("*").alias("n"))


def complete_answers(cases: DataFrame, key: str, text: str, facts: str, *by: str, digits: int = 6) -> DataFrame:
    """(by, cases, share, complete): of questions that ask for several facts, the mean share of facts that the answer has, and
    how many answers have all."""
    n = F.size(F.filter(facts, lambda f: F.coalesce(T.contains_fact(F.coalesce(F.col(text), F.lit("")), f), F.lit(False))))
    x = cases.where(F.size(facts) >= 2).withColumn("__s", n / F.size(facts))
    return x.groupBy(*by).agg(F.count("*").alias("cases"), F.round(F.avg("__s"), digits).alias("share"), F.count_if(F.col("__s") == 1).alias("complete"))


def second_run(log: DataFrame, digits: int = 6) -> DataFrame:
    """One row of a log (base_correct, correct, base_hallucination, hallucination): gained and lost cases and inventions that
    came and went, each with the exact McNemar p-value."""
    c, b = F.col("correct"), F.col("base_correct")
    h, g = F.coalesce(F.col("hallucination"), F.lit(False)), F.coalesce(F.col("base_hallucination"), F.lit(False))
    x = log.agg(F.count_if(c & ~b).alias("gained"), F.count_if(b & ~c).alias("lost"), F.count_if(h & ~g).alias("invented"), F.count_if(g & ~h).alias("corrected"))
    return x.withColumns({"p": F.round(S.mcnemar(F.col("gained"), F.col("lost")), digits), "p_invented": F.round(S.mcnemar(F.col("invented"), F.col("corrected")), digits)})


def audit(log: DataFrame, key: str, scorer: str, expert: str, digits: int = 6) -> DataFrame:
    """One row: verdicts of a scorer beside an expert's: n, agreement, kappa, the two kinds of disagreement, and the cases."""
    s, e = F.col(scorer), F.col(expert)
    c = log.where(s.isNotNull() & e.isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(s == e).alias("same"), F.count_if(s).alias("a"), F.count_if(e).alias("b"), F.count_if(s & ~e).alias("too_kind"),
        F.count_if(~s & e).alias("too_strict"), F.array_sort(F.collect_list(F.when(s != e, F.col(key)))).alias("cases"),
    )
    kappa = S.kappa(F.col("same"), F.col("a"), F.col("b"), F.col("n"))
    return c.select("n", F.round(S.rate(F.col("same"), F.col("n")), digits).alias("agreement"), F.round(kappa, digits).alias("kappa"), "too_kind", "too_strict", "cases")


def ladder_extremes(steps: DataFrame, order: str, gain: str, catch: str) -> DataFrame:
    """One row: the step with the largest gain over the one before, and the one with the lowest catch rate."""
    w = Window.orderBy(order)  # the steps of an ablation, a few rows
    x = steps.withColumn("__d", F.col(gain) - F.lag(gain).over(w))
    return x.agg(F.max_by(order, F.struct("__d", -F.col(order))).alias("best_step"), F.max("__d").alias("gain"), F.min_by(order, F.struct(catch, order)).alias("lowest_step"), F.min(catch).alias("catch"))


def profile_report(log: DataFrame, *by: str) -> DataFrame:
    """(by, cases, answered, refused_rightly, corrected, by_reason): of an A/B run's questions (kind Positive, Negative or
    Adversarial, refused, correct, reason)."""
    kind, refused = F.col("kind"), F.col("refused")
    reasons = log.where("refused").groupBy(*by, "reason").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("by_reason"))
    g = log.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if((kind == "Positive") & ~refused).alias("answered"), F.count_if((kind == "Negative") & refused).alias("refused_rightly"), F.count_if((kind == "Adversarial") & F.col("correct")).alias("corrected"))
    return g.join(reasons, list(by), "left")


def primary_codes(notes: DataFrame, codes: str) -> DataFrame:
    """(code, n): the first code of each annotation."""
    return notes.where(F.size(codes) > 0).groupBy(F.col(codes)[0].alias("code")).agg(F.count("*").alias("n"))


def collapsed(rows: DataFrame, *keys: str, value: str = "score") -> DataFrame:
    """Rows of one key as one, with the largest value."""
    return rows.groupBy(*keys).agg(F.max(value).alias(value), F.count("*").alias("rows"))


def throughput(pairs: DataFrame, key: str, sample: int, seed: str = "t", digits: int = 6) -> DataFrame:
    """One row: of ``sample`` cases in the order of their hashes, the mean and the median number of pairs, and all of them."""
    per = pairs.groupBy(key).agg(F.count("*").alias("n"))
    some = per.orderBy(F.sha1(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(sample)
    return some.agg(F.count("*").alias("cases"), F.sum("n").alias("pairs"), F.round(F.avg("n"), digits).alias("mean"), F.median("n").alias("median"))


def stratified_sample(df: DataFrame, key: str, stratum: str, shares: dict[str, int]) -> DataFrame:
    """The first rows of each stratum in the order of their ids' SHA-1, as many as asked for."""
    out = None
    for name, n in shares.items():
        x = df.where(F.col(stratum) == name).orderBy(F.sha1(F.col(key).cast("string")), key).limit(n)
        out = x if out is None else out.unionByName(x)
    return out


#: Answers of each kind and length, the first ones by name, among which a case looks first.
LEADERS = 4


def answer_swaps(cases: DataFrame, key: str, group: str, claim: str, answer: str) -> DataFrame:
    """(key, other, text): claims with their answer replaced by another one of their group: of the same kind (with or without
    digits), neither holding the other, the nearest in length, then the first; only if the claim has the answer and not
    the other one.

    A case first looks at the ``LEADERS`` first distinct answers of each length, which are one row for each group and kind.
    That settles it unless one holds the other for all leaders of a length as near as the one found, and the length has
    more answers; such cases alone are held against all answers of those lengths.
    """
    trimmed_ = F.btrim(answer, F.lit(' "«»'))
    digits = lambda c: c.rlike(r"\d")
    x = cases.withColumn("__a", trimmed_).withColumn("__n", T.normalize(F.col("__a"))).where(F.length("__a") >= 2)
    x = x.select(key, F.col(group).alias("__g"), F.col(claim).alias("__c"), "__a", "__n", digits(F.col("__a")).alias("__k"))
    others = cases.select(F.col(group).alias("__g"), trimmed_.alias("other")).where("other is not null").distinct()
    others = others.withColumns({"on": T.normalize(F.col("other")), "__k": digits(F.col("other")), "l": F.length("other")}).where("on <> ''")
    nth = F.row_number().over(Window.partitionBy("__g", "__k", "l").orderBy("other"))
    length = others.withColumn("nth", nth).groupBy("__g", "__k", "l").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("nth") <= LEADERS, F.struct("other", "on"))).alias("first"))
    lengths = length.groupBy("__g", "__k").agg(F.collect_list(F.struct("l", "n", "first")).alias("lengths"))
    apart = lambda a, b: ~F.contains(a, b) & ~F.contains(b, a)

    def look(n: Column, l: Column) -> Column:
        fit = F.filter(l["first"], lambda o: apart(n, o["on"]))
        return F.struct(l["l"].alias("l"), (l["n"] > F.size(l["first"])).alias("more"), F.array_min(F.transform(fit, lambda o: o["other"])).alias("other"))

    y = x.join(lengths, ["__g", "__k"])
    seen = T.bound(F.struct("__n", F.length("__a").alias("l"), "lengths"), lambda s: F.transform(s["lengths"], lambda l: F.struct(F.abs(l["l"] - s["l"]).alias("d"), look(s["__n"], l).alias("x"))))
    y = y.select(key, "__g", "__k", "__c", "__a", "__n", seen.alias("seen"))
    best = F.array_min(F.transform(F.filter("seen", lambda s: s["x"]["other"].isNotNull()), lambda s: F.struct(s["d"].alias("d"), s["x"]["other"].alias("other"))))
    y = y.withColumn("o", best)
    open_ = F.transform(F.filter("seen", lambda s: s["x"]["other"].isNull() & s["x"]["more"] & (F.col("o").isNull() | (s["d"] <= F.col("o.d")))), lambda s: s["x"]["l"])
    y = y.withColumn("open", open_).drop("seen")
    rest = y.where(F.size("open") > 0).select(key, "__g", "__k", "__n", F.length("__a").alias("la"), F.explode("open").alias("l")).join(others, ["__g", "__k", "l"])
    rest = rest.where(apart(F.col("__n"), F.col("on"))).groupBy(key).agg(F.min(F.struct(F.abs(F.col("l") - F.col("la")).alias("d"), "other")).alias("r"))
    y = y.join(rest, key, "left").withColumn("o", F.array_min(F.array("o", "r"))).where("o is not null and __n <> ''")
    at = F.expr("locate(lower(__a), lower(__c))")
    text = F.concat(F.substring("__c", F.lit(1), at - 1), F.col("o.other"), F.substring("__c", at + F.length("__a"), F.length("__c")))
    return y.where((at > 0) & ~F.contains(T.normalize("__c"), T.normalize("o.other"))).select(key, F.col("o.other").alias("other"), text.alias("text"))


def table_stress(rows: DataFrame) -> DataFrame:
    """(id, table, seq, column, value, wrong): cells of tables with a key column, each with the value of the next row, around the
    end, that differs from it.  A key column is one whose values are all filled and different; the first such one names
    its row, the others are changed."""
    x = rows.select("id", "table", "seq", F.posexplode("cells").alias("column", "value"))
    n = rows.groupBy("id", "table").agg(F.count("*").alias("rows"))
    per = x.groupBy("id", "table", "column").agg(F.countDistinct("value").alias("d"), F.count_if(F.col("value") != "").alias("f")).join(n, ["id", "table"])
    keys = per.where((F.col("d") == F.col("rows")) & (F.col("f") == F.col("rows")) & (F.col("rows") >= 2)).groupBy("id", "table").agg(F.min("column").alias("key"))
    y = x.join(keys, ["id", "table"]).where((F.col("column") != F.col("key")) & (F.col("value") != ""))
    # Of a column, the next different value: equal values that follow one another are one run.
    c = Window.partitionBy("id", "table", "column").orderBy("seq")
    y = y.withColumn("run", F.sum(F.when(F.col("value") == F.lag("value").over(c), 0).otherwise(1)).over(c))
    runs = y.groupBy("id", "table", "column", "run").agg(F.first("value").alias("value"))
    r = Window.partitionBy("id", "table", "column").orderBy("run")
    whole = Window.partitionBy("id", "table", "column").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.lead("value").over(r)
    first, second = F.first("value").over(whole), F.nth_value("value", 2).over(whole)
    wrong = F.coalesce(after, F.when(first != F.col("value"), first), second)
    runs = runs.select("id", "table", "column", "run", wrong.alias("wrong"))
    return y.join(runs, ["id", "table", "column", "run"]).where("wrong is not null and wrong <> value").select("id", "table", "seq", "column", "value", "wrong")


#: Rows of a range within which the next one of another kind is looked for by a window.
RANGE_ROWS = 100_000


def next_of_other(rows: DataFrame, key: str, kind: str, by: str, most: int = RANGE_ROWS) -> DataFrame:
    """(key, other): for each row the next one of its group (``by``), by number and around the end, of another ``kind``; rows of
    groups of one kind have none.

    Numbers are cut into ranges; within one, a window finds the first row after the run of the row's own kind.  Where a
    range ends first, what follows is in its group's summary: the first row of the next range, and the first one whose
    kind differs from that one's.
    """
    d = rows.select(key, kind, by).where(F.col(key).isNotNull())
    size = d.agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).first()
    ranges = max(1, -(-(size["n"] or 0) // most))
    width = max(1.0, ((size["b"] or 0) - (size["a"] or 0) + 1) / ranges)
    x = d.withColumn("__r", F.floor((F.col(key) - F.lit(size["a"] or 0)) / F.lit(width)).cast("int"))
    w = Window.partitionBy(by, "__r").orderBy(key)
    x = x.withColumn("__run", F.sum(F.when(F.col(kind) != F.lag(kind).over(w), 1).otherwise(0)).over(w))
    after = Window.partitionBy(by, "__r").orderBy("__run").rangeBetween(1, 1)
    x = x.withColumn("__next", F.min(key).over(after))
    first = F.min(F.struct(F.col(key).alias("k"), F.col(kind).alias("kind")))
    a = x.groupBy(by, "__r").agg(first.alias("a"))
    b = x.join(a, [by, "__r"]).where(F.col(kind) != F.col("a.kind")).groupBy(by, "__r").agg(first.alias("b"))
    # Ranges twice round.  Neighbouring ranges that begin with one kind are a stretch, which ends with the first that has
    # another one; what differs first from a stretch's kind is there, or the next stretch begins with it.
    s = a.join(b, [by, "__r"], "left")
    s = s.withColumn("__at", F.col("__r").cast("long")).unionByName(s.withColumn("__at", F.col("__r").cast("long") + ranges))
    o = Window.partitionBy(by).orderBy("__at")
    ends = F.lag("b").over(o).isNotNull() | (F.lag("a.kind").over(o) != F.col("a.kind"))
    s = s.withColumn("__s", F.sum(F.when(ends, 1).otherwise(0)).over(o))
    last = F.last("b").over(Window.partitionBy(by, "__s").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begins = F.min(F.struct("__at", "a")).over(Window.partitionBy(by).orderBy("__s").rangeBetween(1, 1))["a"]
    s = s.withColumn("other", F.coalesce(last, begins))
    follow = s.withColumns({"fa": F.lead("a").over(o), "fb": F.lead("other").over(o)}).where(F.col("__at") < ranges).select(by, "__r", "fa", "fb")
    y = x.join(follow, [by, "__r"], "left")
    beyond = F.when(F.col("fa.kind") != F.col(kind), F.col("fa.k")).otherwise(F.when(F.col("fb.kind") != F.col(kind), F.col("fb.k")))
    return y.select(key, F.coalesce("__next", beyond).alias("other")).where("other is not null")
