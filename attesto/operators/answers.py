"""Questions to published answers: a caller's backend drafts from numbered sources, what it says is verified, and refused
drafts are thought over by a backend that reasons, if the caller has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Rules
from ..functions import text as T
from ..storage import Workspace
from . import claims as C
from .runs import think_retry

#: A backend: (question, sources) as Columns to struct(text, finish), an expression or an Arrow function.  Sources are an
#: array of struct(source_id, text); finish is "stop" or "eos_token" if the reply is whole.
Backend = Callable[[Column, Column], Column]
#: Ways a reply may end.
FINISHES = ("stop", "eos_token", "length", "context_budget", "cancelled")


def checked_reply(reply: Column) -> Column:
    """A backend's reply, or an error if it is none: without a text, or with an end that isn't known."""
    bad = reply.isNull() | reply["text"].isNull() | ~F.coalesce(reply["finish"].isin(*FINISHES), F.lit(False))
    return F.when(bad, F.raise_error(F.lit(f"a backend must give a text and one of {', '.join(FINISHES)}"))).otherwise(reply)


def sources_of(contexts: DataFrame, key: str) -> DataFrame:
    """(key, sources): the sources (key, source_id, text) of each question by their numbers."""
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    listed = F.array_sort(F.collect_list(F.struct(number.alias("n"), "source_id", "text")))
    return contexts.groupBy(key).agg(F.transform(listed, lambda s: F.struct(s["source_id"].alias("source_id"), s["text"].alias("text"))).alias("sources"))


def _published(asked: DataFrame, contexts: DataFrame, key: str, backend: Backend, canonical: str, ws: Workspace, name: str, rules: Rules, nli, second) -> DataFrame:
    """(key, reply, finish, facts, accepted, refused, reason, text) of one round: replies are made once and written, as a model
    mustn't be asked again whenever a result is read."""
    reply = checked_reply(backend(F.col("question"), F.col("sources")))
    said = ws.save(asked.withColumn("r", reply).select(key, F.col("r.text").alias("reply"), F.col("r.finish").alias("finish")), name)
    checked = C.publish(C.verify(said, contexts, key, "reply", rules, nli, second).join(said.select(key, "finish"), key), key, "finish")
    x = said.join(checked, key, "left").withColumn("refused", F.coalesce("refused", F.lit(True)))
    reason = C.refusal_reason(F.col("refused"), F.col("finish"), F.col("reply"), canonical)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return ws.save(x.select(key, "reply", "finish", zero("facts"), zero("accepted"), "refused", reason.alias("reason"), "text"), f"{name}-checked")


def answered(
    questions: DataFrame, contexts: DataFrame, key: str, text: str, draft: Backend, think: Backend | None = None, mode: str = "refusal",
    canonical: str = "", rules: Rules = Rules(), nli=C.heuristic_nli, second=None,  # noqa: B008
) -> DataFrame:
    """(key, path, finish, facts, accepted, refused, reason, text): one row for each question.

    Questions without sources are refused without a draft (``no_sources``).  A refusal for which ``mode`` says so (see
    ``think_retry``) is thought over by ``think``, and what that gives counts.  ``canonical`` is the reply by which a model
    itself refuses.  Each backend is asked once for each question that it gets.
    """
    ws = Workspace(questions.sparkSession, "answers")
    q = questions.select(key, F.coalesce(F.col(text), F.lit("")).alias("question"))
    asked = ws.save(q.join(sources_of(contexts, key), key), "asked")
    first = _published(asked, contexts, key, draft, canonical, ws, "draft", rules, nli, second)
    out = first.withColumn("path", F.array(F.lit("draft")))
    if think is not None:
        again = first.where(think_retry(F.col("reason"), mode)).select(key)
        thought = _published(asked.join(again, key, "left_semi"), contexts, key, think, canonical, ws, "think", rules, nli, second)
        out = out.join(again, key, "left_anti").unionByName(thought.withColumn("path", F.array(F.lit("draft"), F.lit("think"))))
    none = q.join(asked.select(key), key, "left_anti").select(key).withColumns({
        "path": F.array().cast("array<string>"), "finish": F.lit(None).cast("string"), "facts": F.lit(0).cast("long"), "accepted": F.lit(0).cast("long"),
        "refused": F.lit(True), "reason": F.lit("no_sources"), "text": F.lit(None).cast("string"),
    })
    columns = [key, "path", "finish", "facts", "accepted", "refused", "reason", "text"]
    return out.select(*columns).unionByName(none.select(*columns))


def quoting(which: Callable[[Column], Column]) -> Backend:
    """A stand-in for a model: it says one sentence of the first source and cites it."""
    return lambda question, sources: F.struct(F.concat(which(T.sentences(sources[0]["text"])), F.lit(" ["), sources[0]["source_id"], F.lit("]")).alias("text"), F.lit("stop").alias("finish"))
