"""Answers into claims, claims against their sources, and what is published.

A claim carries its row along, with the first of its windows: sources, windows and scores are joined to it and summed up
again, so each step is one pass and no table is joined with itself.  What a claim and a source share is worked out once for the pair; windows carry
their own text only.
"""

from __future__ import annotations

import re
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

from .. import config
from ..config import JUDGE_FEATURES, JUDGE_INTERCEPT, JUDGE_WEIGHTS, Judge, Rules
from ..functions import stats as S
from ..functions import text as T
from ..shipping import ship
from ..storage import Workspace
from . import tables as B


def _marks(protected: str, stops: str, tail: str, run: str) -> re.Pattern:
    """What the scan of an answer finds: stretches that end no sentence, and ends: a stop with more marks and the citations
    after it, before a blank, a bracket or the end of the text; a line's end ends a sentence anywhere."""
    return re.compile(rf"(?i)(?P<inside>{protected}|(?<=\d)\.(?=\d))|(?P<end>(?>[{stops}]{run}(?:{tail})*)(?=\s|\[|\Z)|(?>\n{run}(?:{tail})*))")


_OLD = _marks(config.ABBREVIATIONS_OLD, r".!?;。！？", r"\s*\[S[^\]\n]*\]", r"[.!?。！？]*")
_NEW = _marks(f"{config.ABBREVIATIONS}|(?-i:{config.INITIAL})", r".!?。！？", r"\s*,?\s*\[S[^\]\n]*\]", r"(?:(?!\.{3})[.!?。！？])*")
#: The same, where only ASCII letters, digits and _ are of a word that an abbreviation can't begin in.
_PLAIN = re.compile(_NEW.pattern.replace(r"\b", r"(?a:\b)"))
_LABEL, _BULLET, _FENCE = re.compile(r"(?i)^\s*(?:ответ|answer)\s*:\s*"), re.compile(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"), re.compile(r"(?m)^\s*```[^\n]*$")


def segment(text: str, old: bool = False, ascii: bool = False) -> list[str]:
    """Sentences of an answer, each with the citations that follow it.  Decimals, abbreviations and (new) initials and
    ellipses don't end one; the old way also splits at semicolons.  With ``ascii`` (new only), abbreviations stand between
    ASCII letters and others, as in engines whose word boundaries know ASCII only."""
    body = _FENCE.sub("", _BULLET.sub("", _LABEL.sub("", text.strip())))
    ends = [m.end() for m in (_OLD if old else _PLAIN if ascii else _NEW).finditer(body) if m.lastgroup == "end"]
    return [piece for a, b in pairwise([0, *ends, len(body)]) if (piece := body[a:b].strip())]


def segmented(texts: Column | str, ascii: bool = False) -> Column:
    ship(SparkSession.active())
    return F.pandas_udf(lambda x: x.map(lambda v: segment(v or "", ascii=ascii)), t.ArrayType(t.StringType()))(texts)


def claims(answers: DataFrame, key: str, text: str, ascii: bool = False) -> DataFrame:
    """(key, paragraph, ix, claim, own, malformed): the claims of answers in order, with the sources they cite; malformed is a
    claim with a citation that names no source.  ``ascii`` is that of ``segment``."""
    blocks = answers.select(key, F.posexplode(F.filter(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda b: F.trim(b) != "")).alias("paragraph", "block"))
    x = blocks.select(key, "paragraph", F.posexplode(segmented("block", ascii)).alias("at", "claim"))
    ix = F.row_number().over(Window.partitionBy(key).orderBy("paragraph", "at")) - 1
    marks = F.regexp_extract_all("claim", F.lit(T.ANY_CITATION), F.lit(0))
    return x.select(key, "paragraph", ix.alias("ix"), "claim", T.own_citations("claim").alias("own"), F.exists(marks, lambda m: ~m.rlike(f"^{T.CITATION}$")).alias("malformed"))


def inherit(c: DataFrame, key: str) -> DataFrame:
    """Adds source_ids and inherited: an uncited claim takes the citation of the next, then the previous claim of its
    paragraph that has one, then of the previous, then the next in the answer; not where it cites amiss itself."""
    cited = F.when(F.size("own") > 0, F.col("own"))
    whole, part = Window.partitionBy(key).orderBy("ix"), Window.partitionBy(key, "paragraph").orderBy("ix")
    after = lambda w: F.first(cited, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = lambda w: F.last(cited, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = F.when(~F.col("malformed"), F.coalesce(after(part), before(part), before(whole), after(whole)))
    out = c.withColumn("__found", found)
    return out.withColumn("source_ids", F.coalesce(cited, "__found", F.array().cast("array<string>"))).withColumn("inherited", cited.isNull() & F.col("__found").isNotNull()).drop("__found")


def kind(claim: str | Column) -> Column:
    return F.when(T.is_absence(claim), "absence").when(T.is_verdict(claim), "verdict").otherwise("fact")


def hypothesis(claim: str | Column) -> Column:
    """What of a claim is held against its sources: no citations, no verdict before a statement."""
    return T.strip_verdict(F.trim(F.regexp_replace(F.col(claim) if isinstance(claim, str) else claim, T.ANY_CITATION, "")))


def heuristic_nli(premise: Column, hypothesis: Column) -> Column:
    """Entailed if the words of the hypothesis stand in the premise in a row, else neutral."""
    words = lambda x: F.trim(F.regexp_replace(T.fold(x), r"[^\p{L}\p{N}_]+", " "))
    both = F.struct(words(premise).alias("p"), words(hypothesis).alias("h"))
    e = T.bound(both, lambda x: F.when((x["h"] != "") & F.contains(x["p"], x["h"]), 1.0).otherwise(0.0))
    return T.bound(e, lambda e: F.struct(e.alias("e"), (1 - e).alias("n"), F.lit(0.0).alias("c")))


def labelled_nli(scores: Column, labels: dict[int, str]) -> Column:
    """A model's class probabilities (an array) as (e, n, c), by the names of its classes, never by their order; a model of two
    classes knows no contradiction."""
    at = {name.strip().lower(): i for i, name in labels.items()}
    if len(at) != len(labels) or sorted(labels) != list(range(len(labels))):
        raise ValueError("each class needs a name and a place of its own")
    if set(at) == {"entailment", "neutral", "contradiction"}:
        return F.struct(scores[at["entailment"]].alias("e"), scores[at["neutral"]].alias("n"), scores[at["contradiction"]].alias("c"))
    if set(at) == {"entailment", "not_entailment"}:
        e = scores[at["entailment"]]
        return F.struct(e.alias("e"), (1 - e).alias("n"), F.lit(0.0).alias("c"))
    raise ValueError(f"classes can't be told apart: {labels}")


def prepared(contexts: DataFrame, key: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(key, source_id, document_id, premise, header, extra, anchor_text, texts) of sources (key, source_id, text, and if there
    are, title, section_path, document_id): what every claim that cites a source is held against.

    ``texts`` are the windows as (text, shown): the premise itself (the first), runs of one and two sentences and table rows,
    and with a title each again below ``Title. Section.``; shown is null where it is the text.  ``anchor_text`` also has the headings and the bit patterns
    of table rows.
    """
    have = set(contexts.columns)
    opt = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    x = contexts.select(
        key, "source_id", "text", opt("document_id", "string").alias("document_id"), opt("title", "string").alias("title"),
        F.coalesce(opt("section_path", "array<string>"), F.array().cast("array<string>")).alias("section_path"),
        T.clean_premise("text").alias("premise"),
    ).withColumn("source", F.struct(key, "source_id"))
    empty = F.array().cast("array<string>")
    if rules.table_rows:
        rows = B.markdown_tables(x.where(F.contains("text", F.lit("|"))), "source", "text")
        lines = B.row_claims(rows).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "text"))), lambda s: s["text"]).alias("rows"))
        bits = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(B.bit_runs("cells")))).alias("bits"))
        x = x.join(lines, F.col("source") == lines["id"], "left").drop("id").join(bits, F.col("source") == bits["id"], "left").drop("id")
    else:
        x = x.withColumns({"rows": F.lit(None).cast("array<string>"), "bits": F.lit(None).cast("array<string>")})
    windows = F.array_distinct(F.concat(T.sentence_windows(T.sentences("premise")), F.coalesce("rows", empty)))
    x = x.withColumn("windows", windows).withColumn("header", T.premise_header("title", "section_path") if rules.titles else F.lit(""))
    own = lambda texts: F.transform(texts, lambda w: F.struct(w.alias("text"), F.lit(None).cast("string").alias("shown")))
    framed = F.transform(F.concat("windows", F.array("premise")), lambda w: F.struct(w.alias("text"), F.concat_ws(" ", "header", w).alias("shown")))
    texts = F.concat(own(F.array("premise")), own(F.col("windows")), F.when(F.col("header") != "", framed).otherwise(F.array().cast("array<struct<text:string,shown:string>>")))
    anchors = F.concat_ws(" ", "section_path", "premise", F.coalesce("bits", empty))
    return x.select(key, "source_id", "document_id", "premise", "header", anchors.alias("anchor_text"), texts.alias("texts"))


def paired(cited: DataFrame, sources: DataFrame, key: str, rules: Rules) -> DataFrame:
    """Rows (key, ix, source_id, claim's row, h, anchors, found, overlap, code_span, texts) of claims and ``prepared`` sources that
    they cite; one without a source for a claim that cites none that is known.  Everything here is worked out once for
    a claim and a source, and what is the claim's alone before it meets its sources.  The claim's row stands with the first
    of them only: it names them all, so with each it would grow with the square of their number."""
    named = F.when((F.col("kind") == "fact") & (F.size("source_ids") > 0), F.col("source_ids")).otherwise(F.array(F.lit(None).cast("string")))
    x = cited.select(key, "ix", F.struct(*cited.columns).alias("claim_row"), hypothesis("claim").alias("h"), named.alias("named")).withColumn("anchors", T.claim_anchors("h"))
    x = x.select(key, "ix", "h", "anchors", F.inline(F.transform("named", lambda s, i: F.struct(s.alias("source_id"), F.when(i == 0, F.col("claim_row")).alias("claim_row")))))
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be put together by size
    x = x.repartition(n, key, "source_id").join(sources.repartition(n, key, "source_id"), [key, "source_id"], "left")
    known = F.col("premise").isNotNull()
    return x.select(
        key, "ix", "source_id", "claim_row", "h", "anchors", "texts", known.alias("known"), "document_id",
        F.when(known, T.anchors_found("anchors", "anchor_text")).alias("found"),
        F.when(known, T.content_overlap("h", "premise")).alias("overlap"),
        F.when(known, T.code_span("h", "premise", rules.code_span_chars)).alias("code_span"),
    )


def scored(pairs: DataFrame, key: str, nli=heuristic_nli, second=None) -> DataFrame:
    """The pairs' windows: (key, ix, source_id, known, w), scores a and b (e, n, c; null where a model can't score) and whether it has
    all anchors of the claim.  What else a pair has stands with its first window only.  Scores are made in a generator, which
    works them out once however often they are used."""
    x = pairs.withColumn("__h", T.normalize_keywords("h")).select("*", F.posexplode_outer("texts").alias("w", "t")).drop("texts")
    text, h = T.normalize_keywords(F.coalesce("t.shown", "t.text")), F.col("__h")
    none = F.lit(None).cast("struct<e:double,n:double,c:double>")
    a, b = nli(text, h), second(text, h) if second else none
    made = F.struct(
        F.when(F.col("t").isNotNull(), a).alias("a"), F.when(F.col("t").isNotNull(), b).alias("b"),
        ((F.size("anchors") > 0) & T.anchors_present("anchors", F.col("t.text"))).alias("in_window"),
    )
    x = x.select(*(c for c in x.columns if c not in ("t", "__h")), F.inline(F.array(made)))
    first = F.coalesce("w", F.lit(0)) == 0
    light = (key, "ix", "source_id", "known", "w", "a", "b", "in_window")
    return x.select(*(c if c in light else F.when(first, F.col(c)).alias(c) for c in x.columns))


def by_source(windows: DataFrame, key: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """What the windows of a source say together.  e, c and support are those of the first way of support that holds: a window
    by itself, a window with all anchors of the claim, a literal of the claim in the source; without one they are the
    whole text's.  The rest are features of the judge."""
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    part, whole = w > 0, w == 0
    best = lambda when: F.max(F.when(when, F.struct(a["e"].alias("e"), (-w).alias("w"), a["c"].alias("c"))))
    alone = part & (a["e"] >= rules.window_entailment) & (a["c"] < rules.window_contradiction)
    anchored = part & F.col("in_window") & (a["e"] >= rules.anchor_entailment) & (a["c"] < rules.anchor_contradiction)
    low = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    g = windows.groupBy(key, "ix", "source_id").agg(
        *(first(c) for c in ("claim_row", "h", "anchors", "known", "document_id", "found", "overlap", "code_span")),
        best(alone).alias("window"), best(anchored).alias("anchor_window"), F.max(F.when(whole, a)).alias("full"), F.max(F.when(whole, b)).alias("full_b"),
        F.max(F.when(a.isNotNull(), F.struct((a["e"] - a["c"]).alias("d"), (-w).alias("w"), a["e"].alias("e"), a["c"].alias("c")))).alias("literal"),
        F.max(F.struct(a["e"].alias("e"), (-w).alias("w"), a["c"].alias("c"))).alias("top"), F.max(a["c"]).alias("a_c"),
        F.max(b["e"]).alias("b_e"), F.max(b["c"]).alias("b_c"), F.max((a["e"] + b["e"]) / 2).alias("ab_e"),
    )
    literal = F.col("code_span") & (F.col("literal.c") < rules.code_span_contradiction)
    support = F.when(F.col("window").isNotNull(), "window").when(F.col("anchor_window").isNotNull(), "anchor_window").when(literal, "code_span")
    chosen = lambda c: F.coalesce(F.col(f"window.{c}"), F.col(f"anchor_window.{c}"), F.when(literal, F.col(f"literal.{c}")), F.col(f"full.{c}"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    has = F.size("anchors") > 0
    features = {
        "a_e_max": S.logit(zero(F.col("top.e"))), "a_c_at_a": zero(F.col("top.c")), "a_c_max": zero(F.col("a_c")), "b_e_max": S.logit(zero(F.col("b_e"))),
        "b_c_max": zero(F.col("b_c")), "ab_e_max": S.logit(zero(F.col("ab_e"))), "a_full_e": S.logit(zero(F.col("full.e"))), "a_full_c": zero(F.col("full.c")),
        "b_full_e": S.logit(zero(F.col("full_b.e"))), "overlap": F.col("overlap"), "code_span": F.col("code_span"),
        "anchors_ok": ~has | (F.size("found") == F.size("anchors")), "has_anchors": has,
    }
    return g.select(
        key, "ix", "source_id", "claim_row", "h", "anchors", "known", "document_id", "found", support.alias("support"), chosen("e").alias("e"), chosen("c").alias("c"),
        low(zero(F.col("top.e"))).alias("a_e"), low(zero(F.col("b_e"))).alias("b_e"),
        F.struct(*(features[f].cast("double").alias(f) for f in JUDGE_FEATURES)).alias("features"),
    )


def evidence(cited: DataFrame, contexts: DataFrame, key: str, nli=heuristic_nli, second=None, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``by_source`` of claims (``inherit`` with kind) and sources."""
    return evidence_of(cited, prepared(contexts, key, rules), key, nli, second, rules)


def evidence_of(cited: DataFrame, sources: DataFrame, key: str, nli=heuristic_nli, second=None, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The same of sources that are ``prepared``."""
    return by_source(scored(paired(cited, sources, key, rules), key, nli, second), key, rules)


def supports(e: Column, c: Column, supported: Column, rules: Rules) -> Column:
    """Whether a source supports a claim: by a way of support, or by the whole text without contradiction."""
    return supported | ((c < rules.contradiction) & ((e > rules.entailment) | (e >= rules.strong)))


def _decided(rules: Rules) -> dict[str, Column]:
    """What the sources (e, c, anchored, supported) of a claim say together, as aggregates."""
    e, c, supported = F.col("e"), F.col("c"), F.col("supported")
    yes = F.coalesce(supports(e, c, supported, rules), F.lit(False))
    plain = F.coalesce((e > rules.entailment) & (c < rules.contradiction), F.lit(False))
    return {
        "anchored": F.bool_or("anchored"), "any": F.bool_or(yes), "veto": F.bool_or(~yes & (c >= rules.veto)),
        "against": F.coalesce(F.bool_or(~supported & (c >= rules.contradiction)), F.lit(False)),
        "all": F.bool_and(supported | plain), "strong_one": F.bool_or(supported | F.coalesce(e >= rules.strong, F.lit(False))), "e": F.max("e"), "c": F.max("c"),
    }


def _support_first() -> Column:
    against = F.when(F.col("against"), "contradiction").otherwise("unverified")
    return F.when(~F.col("anchored"), against).when(F.col("any"), F.when(F.coalesce("veto", F.lit(False)), "contradiction").otherwise("verified")).otherwise(against)


def _strict() -> Column:
    return F.when(F.col("against"), "contradiction").when(F.col("anchored") & (F.col("all") | F.col("strong_one")), "verified").otherwise("unverified")


def decide_support_first(sources: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """Status of each claim from (e, c, anchored, supported) of its sources: one supporting source verifies it unless
    another contradicts outright; without support, any contradiction counts; a missing anchor never verifies."""
    g = sources.groupBy(*keys).agg(*(c.alias(n) for n, c in _decided(rules).items()))
    return g.select(*keys, _support_first().alias("status"), "e", "c")


def decide_strict(sources: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """The stricter rule: any contradiction decides; else all sources must support, or one strongly."""
    g = sources.groupBy(*keys).agg(*(c.alias(n) for n, c in _decided(rules).items()))
    return g.select(*keys, _strict().alias("status"))


def single_source_status(e: Column, c: Column, rules: Rules) -> Column:
    """The rule for one source: contradiction first, then entailment above the threshold, or strong."""
    return F.when(c >= rules.contradiction, "contradiction").when((e > rules.entailment) | (e >= rules.strong), "verified").otherwise("unverified")


def alternative_verifiers(windows: DataFrame, key: str, thresholds: tuple[float, ...] = (0.05, 0.5)) -> DataFrame:
    """(key, ix, verifier, accepted): other ways to accept a claim by the whole texts of its sources: one source entails it
    without contradiction, a second model's entailment reaches a threshold anywhere, and the same with all anchors."""
    whole = F.col("w") == 0
    g = windows.groupBy(key, "ix").agg(
        F.bool_or(whole & (F.col("a.e") > 0.4) & (F.col("a.c") < 0.2)).alias("single"), F.max("b.e").alias("b"),
        F.flatten(F.collect_set("found")).alias("found"), F.first("anchors", ignorenulls=True).alias("anchors"),
    )
    there = F.size(F.array_except("anchors", "found")) == 0
    ways = {"single": F.coalesce("single", F.lit(False))} | {f"second_{t}": F.coalesce(F.col("b") >= t, F.lit(False)) for t in thresholds}
    ways |= {f"{name}_anchored": way & there for name, way in list(ways.items())}
    return g.select(key, "ix", F.explode(F.array(*(F.struct(F.lit(n).alias("verifier"), w.alias("accepted")) for n, w in ways.items()))).alias("x")).select(key, "ix", "x.*")


def judge(features: dict[str, Column]) -> Column:
    """The logistic judge's probability that a source supports a claim."""
    return S.sigmoid(sum((w * features[name].cast("double") for name, w in zip(JUDGE_FEATURES, JUDGE_WEIGHTS)), F.lit(JUDGE_INTERCEPT)))


def _graded(config: Judge) -> tuple[dict[str, Column], Column]:
    """What the sources (score, a_e, b_e, a_c_max, b_c_max, anchored of the claim) say together, and the grade by it."""
    worst, denies = F.greatest("a_c_max", "b_c_max"), F.col("b_e") < 0.5
    ok = F.col("anchored") & (F.col("score") >= config.threshold)
    sums = {
        "any": F.bool_or(ok), "veto": F.bool_or(~ok & denies & (worst >= config.veto)), "against": F.bool_or(denies & (worst >= config.contradiction)),
        "score": F.max("score"), "gap": F.max_by(F.abs(F.col("a_e") - F.col("b_e")), F.struct("score", -F.col("a_e"))),
    }
    grade = (
        F.when(F.col("any") & F.col("veto"), "contradicted").when(F.col("any"), "supported").when(F.col("against"), "contradicted")
        .when(F.col("gap") >= config.disagreement, "ambiguous").when(F.col("score") >= config.partial, "partially_supported").otherwise("insufficient_evidence")
    )
    return sums, grade


def judge_grades(sources: DataFrame, config: Judge, *keys: str) -> DataFrame:
    """Grade and status of each claim from (score, a_e, b_e, a_c_max, b_c_max, anchored) of its sources: vetoed, supported,
    contradicted, ambiguous, partly supported, or without enough evidence, in this order."""
    sums, grade = _graded(config)
    x = sources.withColumn("anchored", F.bool_or("anchored").over(Window.partitionBy(*keys)))
    g = x.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items()))
    return g.select(*keys, grade.alias("grade"), _status_of(grade).alias("status"), "score")


def _status_of(grade: Column) -> Column:
    return F.when(grade == "supported", "verified").when(grade == "contradicted", "contradiction").otherwise("unverified")


def ensemble(a: Column, b: Column, how: str) -> Column:
    """Two models' (e, n, c) as one: min, mean, or the first with the second's veto."""
    if how == "mean":
        e, c = (a["e"] + b["e"]) / 2, (a["c"] + b["c"]) / 2
    else:
        e, c = a["e"] if how == "first_veto" else F.least(a["e"], b["e"]), F.greatest(a["c"], b["c"])
    both = a.isNotNull() & b.isNotNull()
    joint = F.struct(e.alias("e"), F.greatest(1 - e - c, F.lit(0.0)).alias("n"), c.alias("c"))
    return F.when(both, joint).when(F.lit(how == "first_veto"), a)


def in_document(sources: DataFrame, p: DataFrame, key: str) -> DataFrame:
    """(key, ix), of ``prepared`` sources p: claims whose missing anchors are identifiers (a control with its enhancement being one) that stand in other
    sources of the answer from the documents that the claim cites."""
    wide = sources.where("known").withColumn("named", T.claim_anchors("h", enhancements=True))
    own = wide.join(p.select(key, "source_id", F.col("anchor_text").alias("own")), [key, "source_id"])
    own = own.withColumn("there", T.anchors_found("named", "own")).groupBy(key, "ix").agg(F.first("named").alias("named"), F.flatten(F.collect_list("there")).alias("there"), F.collect_set("document_id").alias("documents"), F.collect_set("source_id").alias("cited"))
    own = own.withColumn("missing", F.array_except("named", "there")).where((F.size("missing") > 0) & F.forall("missing", T.is_identifier))
    other = p.where("document_id is not null").select(key, F.col("source_id").alias("other"), F.col("document_id").alias("of"), F.col("anchor_text").alias("text"))
    near = own.withColumn("of", F.explode("documents")).join(other, [key, "of"]).where(~F.array_contains("cited", F.col("other")))
    got = near.groupBy(key, "ix").agg(F.first("missing").alias("missing"), F.flatten(F.collect_list(T.anchors_found("missing", "text"))).alias("got"))
    return got.where(F.size(F.array_except("missing", "got")) == 0).select(key, "ix")


def verify(answers: DataFrame, contexts: DataFrame, key: str, text: str, rules: Rules = Rules(), nli=heuristic_nli, second=None, judged: Judge | None = None) -> DataFrame:  # noqa: B008
    """Claims of answers with kind, source_ids, inherited, status, reason, grade, score and co_verified.

    By rules, or (``decision="judge"``) by the logistic judge on both models' scores.  A claim is held against the sources
    that it cites; all its anchors must stand in them together, or (``anchor_scope="document"``) identifiers in other
    sources of the same documents.  Sources are prepared once, as a table of the workspace.
    """
    c = inherit(claims(answers, key, text), key).withColumn("kind", kind("claim"))
    ready = Workspace(answers.sparkSession, "verify").save(prepared(contexts, key, rules), "sources")
    sources = evidence_of(c, ready, key, nli, second, rules).withColumn("supported", F.col("support").isNotNull())
    sources = sources.withColumn("score", judge({f: F.col(f"features.{f}") for f in JUDGE_FEATURES}))
    held = F.size(F.array_except("anchors", F.coalesce(F.flatten(F.collect_set("found").over(Window.partitionBy(key, "ix"))), F.array().cast("array<string>")))) == 0
    x = sources.withColumn("anchored", held)
    if rules.anchor_scope == "document":
        wider = in_document(sources, ready, key).withColumn("wider", F.lit(True))
        x = x.join(wider, [key, "ix"], "left").withColumn("anchored", F.col("anchored") | F.coalesce("wider", F.lit(False))).drop("wider")
    sums, grade = _graded(judged or Judge())
    x = x.withColumns({"a_c_max": F.col("features.a_c_max"), "b_c_max": F.col("features.b_c_max")})
    first = {"claim_row": F.first("claim_row", ignorenulls=True), "h": F.first("h")} | {"known": F.count_if("known"), "cited": F.count("source_id")}
    g = x.groupBy(key, "ix").agg(*(v.alias(n) for n, v in (first | {f"__{n}": s for n, s in sums.items()} | _decided(rules)).items()))
    if rules.decision == "judge":
        g = g.withColumns({n: F.col(f"__{n}") for n in sums})
        status = _status_of(grade)
    else:
        status = _strict() if rules.aggregation == "strict" else _support_first()
        grade = F.when(status == "verified", "supported").when(status == "contradiction", "contradicted").otherwise("insufficient_evidence")
    row = F.col("claim_row")
    reason = (
        F.when(row["kind"] == "absence", "absence_statement").when(row["kind"] == "verdict", "verdict_marker").when(~F.col("h").rlike(r"[\p{L}\p{N}_]"), "empty_claim")
        .when(row["malformed"], "invalid_citation").when(F.size(row["source_ids"]) == 0, "missing_citation").when(F.col("known") < F.col("cited"), "unknown_citation")
    )
    checked = reason.isNull()
    out = g.select(
        key, "ix", "claim_row", "h", F.when(checked, status).otherwise("unverified").alias("status"), F.when(checked, grade).otherwise("insufficient_evidence").alias("grade"),
        F.when(checked, F.col("__score")).alias("score"),
        F.when(~checked, reason).when(status == "verified", None).when(~F.col("anchored"), "anchor_not_in_source").otherwise("cited_support_not_established").alias("reason"),
    )
    out = co_verify(out, ready, key, rules)
    return out.select(*(F.col(f"claim_row.{n}").alias(n) for n in c.columns), "status", "reason", "grade", F.round("score", 6).alias("score"), "co_verified")


def co_verify(checked: DataFrame, sources: DataFrame, key: str, rules: Rules) -> DataFrame:
    """With ``prepared`` sources, verifies facts left unverified for want of support if sources that verified another fact of the answer hold all
    their anchors and enough of their words.  Claims verified here don't vouch for others.  What a source has of them is found
    source by source: no row holds the texts of several."""
    row = F.col("claim_row")
    vouching = F.when((row["kind"] == "fact") & (F.col("status") == "verified"), row["source_ids"])
    shared = F.array_intersect(row["source_ids"], F.flatten(F.collect_list(vouching).over(Window.partitionBy(key))))
    open_ = F.when((row["kind"] == "fact") & (F.col("reason") == "cited_support_not_established"), shared)
    kept = [c for c in checked.columns if c not in (key, "ix")]
    x = checked.select(key, "ix", "h", F.struct(*kept).alias("rest"), open_.alias("shared"))
    x = x.withColumns({"words": F.when(F.col("shared").isNotNull(), T.content_words("h")), "asked": F.when(F.col("shared").isNotNull(), T.claim_anchors("h"))})
    some = F.when(F.size("shared") > 0, F.col("shared")).otherwise(F.array(F.lit(None).cast("string")))
    x = x.select(key, "ix", "words", "asked", F.inline(F.transform(some, lambda s, i: F.struct(s.alias("source_id"), F.when(i == 0, F.col("rest")).alias("rest")))))
    x = x.join(sources.select(key, "source_id", "premise", "anchor_text"), [key, "source_id"], "left")
    there = F.array_intersect("words", F.array_distinct(F.regexp_extract_all(T.fold("premise"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    held = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    g = x.select(key, "ix", "rest", "words", "asked", there.alias("there"), T.anchors_found("asked", "anchor_text").alias("found"), (F.col("premise") != "").alias("says")).groupBy(key, "ix").agg(
        F.first("rest", ignorenulls=True).alias("rest"), F.first("words").alias("words"), F.first("asked").alias("asked"), held("there").alias("there"), held("found").alias("found"), F.bool_or("says").alias("says"),
    )
    overlap = F.coalesce(F.try_divide(F.size("there").cast("double"), F.size("words")), F.lit(0.0))
    won = F.col("says") & (F.size("found") == F.size("asked")) & (overlap >= rules.co_verification_overlap)
    g = g.select(key, "ix", "rest.*", won.alias("__won"))
    g = g.withColumn("co_verified", F.coalesce("__won", F.lit(False)))
    return g.withColumns({
        "status": F.when(F.col("co_verified"), "verified").otherwise(F.col("status")), "reason": F.when(~F.col("co_verified"), F.col("reason")),
        "grade": F.when(F.col("co_verified"), "supported").otherwise(F.col("grade")),
    }).drop("__won")


def checked_contexts(answers: DataFrame, contexts: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, source_id, problem) of sources of answers that can't be relied on: numbers that don't count from S1, a chunk that
    the index doesn't have, or a text that isn't the chunk's.  ``contexts`` has (key, source_id, chunk_id, text), ``chunks``
    (chunk_id, text)."""
    w = Window.partitionBy(key).orderBy(F.regexp_extract("source_id", r"(\d+)$", 1).cast("int"))
    x = contexts.join(answers.select(key).distinct(), key).withColumn("place", F.concat(F.lit("S"), F.row_number().over(w)))
    x = x.join(chunks.select("chunk_id", F.col("text").alias("stored")), "chunk_id", "left")
    problem = F.when(F.col("place") != F.col("source_id"), "number").when(F.col("stored").isNull(), "unknown_chunk").when(F.col("stored") != F.col("text"), "changed_text")
    return x.select(key, "source_id", problem.alias("problem")).where("problem is not null")


def dossier(checked: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """(key, ix, anchors, missing, missing_everywhere): the anchors of claims (``verify``) that their cited sources lack, and
    those that no source of the answer has."""
    texts = prepared(contexts, key).select(key, "source_id", "anchor_text")
    x = checked.where("kind = 'fact'").select(key, "ix", "source_ids", T.claim_anchors(hypothesis("claim")).alias("anchors")).join(texts, key, "left")
    found = T.anchors_found("anchors", F.coalesce("anchor_text", F.lit("")))
    none = F.array().cast("array<string>")
    cited = F.when(F.array_contains("source_ids", F.col("source_id")), found).otherwise(none)
    g = x.groupBy(key, "ix").agg(F.first("anchors").alias("anchors"), F.flatten(F.collect_list(cited)).alias("cited"), F.flatten(F.collect_list(found)).alias("all"))
    return g.select(key, "ix", "anchors", F.array_except("anchors", "cited").alias("missing"), F.array_except(F.array_except("anchors", "cited"), "all").alias("missing_everywhere"))


def publish(checked: DataFrame, key: str, finish: str | None = None, guard: bool = True) -> DataFrame:
    """One row for each answer: facts, accepted, blocked, rate, refused, text.

    Refused if nothing was accepted, more than half of the facts were blocked, the draft was cut short, or (guard) it
    opens with a negation whose reason isn't verified.  The text has verified facts (inherited citations written
    out), absence statements, and verdicts whose next claim is verified.
    """
    w = Window.partitionBy(key).orderBy("ix")
    fact = F.col("kind") == "fact"
    x = checked.withColumn("__next", F.lead("status").over(w)).withColumn("__n", F.sum(F.when(fact, 1).otherwise(0)).over(w))
    ok = F.col("status") == "verified"
    marks = F.array_join(F.transform("source_ids", lambda s: F.concat(F.lit("["), s, F.lit("]"))), "")
    line = F.when(F.col("kind") == "absence", F.col("claim")).when(F.col("kind") == "verdict", F.when(F.col("__next") == "verified", F.col("claim"))).when(ok, F.when(F.col("inherited"), F.concat_ws(" ", "claim", marks)).otherwise(F.col("claim")))
    first = fact & (F.col("ix") == 0) & T.has_negation("claim")
    done = F.first(F.col(finish)) if finish else F.lit("stop")
    g = x.groupBy(key).agg(
        F.count_if(fact).alias("facts"), F.count_if(fact & ok).alias("accepted"), F.bool_or(first).alias("__negates"),
        F.bool_or(fact & (F.col("__n") == 2) & ~ok).alias("__second"), done.alias("__finish"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ix", line.alias("line")))), lambda s: s["line"].isNotNull()), lambda s: s["line"]), "\n").alias("__text"),
    )
    blocked = F.col("facts") - F.col("accepted")
    rate = F.coalesce(F.try_divide(blocked.cast("double"), F.col("facts")), F.lit(0.0))
    refused = (F.col("accepted") == 0) | (rate > 0.5) | ~F.col("__finish").isin("stop", "eos_token")
    if guard:
        refused = refused | (F.col("__negates") & F.col("__second") & (F.col("facts") > 1))
    return g.select(key, "facts", "accepted", blocked.alias("blocked"), rate.alias("rate"), refused.alias("refused"), F.when(~refused, F.col("__text")).alias("text"))


def refusal_reason(refused: Column, finish: Column, raw: Column, canonical: str) -> Column:
    """Why an answer is withheld, first reason first; null where it is published."""
    why = F.when(finish == "context_budget", "context_budget_exceeded").when(F.trim(raw) == "", "empty_generation").when(~finish.isin("stop", "eos_token"), "generation_incomplete").when(F.trim(raw) == canonical, "llm_refusal").otherwise("nli_verification_failed")
    return F.when(refused, why)


def co_verification_stress(probes: DataFrame, contexts: DataFrame, key: str, hypothesis: str, rules: Rules = Rules(), nli=heuristic_nli, second=None, least: int = 8) -> DataFrame:  # noqa: B008
    """(key, leaked, co_verified): what of ``probes`` (key, hypothesis), none of which its text supports, is published beside a
    supported claim of the same source.

    The draft says the longest sentence of ``least`` words or more of the text (``contexts``: key, text), then the
    hypothesis, both citing it.  Only drafts of two facts whose first is verified count; texts without such a sentence
    have none.  Of equally long sentences, the first is said.
    """
    words = lambda w: F.size(F.split(F.trim(w), r"\s+"))
    long = F.filter(T.sentences(T.clean_premise("text")), lambda w: words(w) >= least)
    best = F.array_max(F.transform(long, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    said = contexts.select(key, F.explode(F.array(best)).alias("said")).where("said is not null")  # worked out once, not again to filter
    draft = F.concat("said", F.lit(" [S1]\n"), T.squeeze(hypothesis), F.lit(" [S1]"))
    answers = probes.join(said, key).select(key, draft.alias("draft"))
    checked = verify(answers, contexts.select(key, F.lit("S1").alias("source_id"), "text"), key, "draft", rules, nli, second).where("kind = 'fact'")
    ok = F.col("status") == "verified"
    g = checked.groupBy(key).agg(F.count("*").alias("n"), F.min_by(ok, "ix").alias("first"), F.max_by(ok, "ix").alias("leaked"), F.max_by("co_verified", "ix").alias("co_verified"))
    return g.where("n = 2 and first").select(key, "leaked", "co_verified")
