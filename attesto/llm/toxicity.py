"""Severity of toxic texts by cumulative-link ordinal regression over words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .workspace import slices

#: Labelled rows that a model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 8000
#: A model uses features that toxic texts have more often than chance allows: FEATURES of them at most, those with the most
#: evidence, and a number of CHANCE features of the sample, at most, expected to pass without cause.  To these come the
#: words and longer beginnings that begin like them and stand in LEAST_TEXTS texts of the sample, as many again at
#: most: some are clean, and get a weight of their own.
FEATURES, CHANCE, LEAST_TEXTS = 1000, 0.01, 4
#: How the weights are held down, and how much the grades above the first count for them.
PENALTY, HIGHER = 2e-4, 0.1
#: Where labels only tell toxic from clean, a toxic text in which so many words are toxic ones counts as severe.
SEVERE_WORDS = 8
BEGINNINGS = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The distinct words of a text, in lower case, and the beginnings of longer ones: inflected or compounded forms
    are many and rare, what they begin with isn't."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in BEGINNINGS))


@dataclass(frozen=True)
class Ordinal:
    """P(grade >= k) = 1 / (1 + exp(cut[k-1] - sum of the weights of a text's features)); one weight for all cuts."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def score(self, text: str) -> list[float]:
        z = sum(self.weights[w] for w in self.weights.keys() & features(text))
        return [1 / (1 + np.exp(np.clip(c - z, -60, 60))) for c in self.cuts]


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l1: float = 1e-6, steps: int = 2000, higher: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts that minimise the mean negative log-likelihood of the binary events grade >= k,
    plus l1 times the weights' absolute sum, by accelerated proximal gradient steps over distinct rows.  Events above
    the first one count ``higher`` times as much for the weights; their cuts are fitted all the same."""
    rows, counts = np.unique(np.column_stack([x, grade.astype(x.dtype)]), axis=0, return_counts=True)
    x, grade, share = rows[:, :-1], rows[:, -1].astype(int), counts / counts.sum()
    d = x.shape[1]
    y = grade[:, None] > np.arange(grades - 1)[None, :]
    rate = (share @ y * len(counts) + 0.5) / (len(counts) + 1)
    cuts, w = np.log((1 - rate) / rate), np.zeros(d)
    centre = share @ x
    u = (x - centre).astype(np.float32)
    # The largest curvature: a quarter of the design's largest squared singular value, by power iteration.
    v = np.ones(d) / np.sqrt(max(d, 1))
    for _ in range(20):
        v = u.T @ (share * (u @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (grades - 1) * float(share @ (u @ v) ** 2) + 0.3)
    a, b, t = w.copy(), cuts.copy(), 1.0
    event = np.where(np.arange(grades - 1) == 0, 1.0, higher)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(b[None, :] - (u @ a.astype(np.float32))[:, None], -60, 60)))
        r = (p - y) * share[:, None]
        new_w = a - step * ((r @ event).astype(np.float32) @ u)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
        new_c = np.sort(b + step * r.sum(axis=0))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        a, b, t = new_w + (t - 1) / t2 * (new_w - w), new_c + (t - 1) / t2 * (new_c - cuts), t2
        moved = max(np.abs(new_w - w).max(initial=0), np.abs(new_c - cuts).max())
        w, cuts = new_w, new_c
        if moved < 1e-6:
            break
    return w, cuts + centre @ w


def evidence(b: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """The exponent of a bound: b or more of n texts are toxic with a probability of exp(-evidence) at most, for a
    feature that says nothing."""
    p = b / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0)
    return np.where(p > share, n * kl, 0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = pa.array([sorted(features(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), words], names=["id", "grade", "text", "words"])


def dose(text: str, lexicon: frozenset[str]) -> int:
    """How many of the text's words, each occurrence counted, are in the lexicon themselves or by a beginning."""
    counts = Counter(_WORD.findall(text.lower()))
    return sum(n for w, n in counts.items() if w in lexicon or any(len(w) > k and f"{w[:k]}*" in lexicon for k in BEGINNINGS))


def _doses(batches: Iterator[pa.RecordBatch], lexicons: tuple[frozenset[str], ...]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [dose(t, lexicons[1 - h]) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "dose"])


def _severe(rows: DataFrame, x: np.ndarray, bad: np.ndarray, half: np.ndarray, vocabulary: list[str], least: float) -> list[int]:
    """The ids of the severe among toxic texts.  Each half of the sample is measured by the telling words of the other
    half, so a text's grade comes from labels of other texts and from how often their words occur in it, not from
    what the model sees of it."""
    lexicons = []
    for h in (0, 1):
        part = x[half == h]
        n, b, share = part.sum(axis=0), part[bad[half == h]].sum(axis=0), bad[half == h].mean() if len(part) else 0.0
        strong = evidence(b, n, share) >= least if 0 < share < 1 else np.zeros(len(n), dtype=bool)
        lexicons.append(frozenset(w for w, good in zip(vocabulary, strong) if good))
    doses = rows.where("grade > 0").select("id", "text", "half").mapInArrow(lambda it: _doses(it, tuple(lexicons)), "id long, dose long")
    return [r["id"] for r in doses.where(F.col("dose") >= SEVERE_WORDS).select("id").collect()]


def fit(spark: SparkSession, docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """A model from ``grades`` (``id_col``, grade 0, 1, ...), fitted on at most ``sample`` labelled documents.

    Only telling words come to the driver, as numbers, with the ids and grades of the sample.  Where labels have two
    grades, toxic texts with SEVERE_WORDS or more occurrences of toxic words get grade 2 (see ``_severe``).  Null
    grades and ids are left out; of the grades of one id the highest counts, of its texts the first in order.
    Without a toxic or a clean label, or a telling word, the model has no weights and gives all texts the same grade.
    """
    ship(spark)
    labelled = grades.select(F.col(id_col).cast("long").alias("id"), F.col("grade").cast("int").alias("grade"))
    labelled = labelled.where("id is not null and grade >= 0").groupBy("id").agg(F.max("grade").alias("grade"))
    texts = docs.select(F.col(id_col).cast("long").alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = texts.select("did").distinct().join(labelled, F.col("did") == F.col("id")).select("id", "grade").orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = texts.join(F.broadcast(ids), F.col("did") == F.col("id")).groupBy("id", "grade").agg(F.min("text").alias("text"))
    rows = chosen.mapInArrow(_features, "id long, grade int, text string, words array<string>")
    rows = rows.withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).persist()
    try:
        sizes = {r["bad"]: r["n"] for r in rows.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
        bad, good = sizes.get(True, 0), sizes.get(False, 0)
        top = (rows.agg(F.max("grade").alias("g")).first()["g"] or 0) + 1
        if not bad or not good:
            return Ordinal({}, tuple([60.0 if not bad else -60.0] * max(1, top - 1)))
        per = rows.select((F.col("grade") > 0).alias("bad"), F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"))
        # P(b or more of n are toxic) <= exp(-n * KL(b / n || share)) for a word that says nothing.
        share, p = bad / (bad + good), F.col("b") / F.col("n")
        kl = p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
        seen = per.where("n > 1").count()
        least = math.log(max(seen, 1) / CHANCE)
        telling = per.where(p > share).withColumn("evidence", F.col("n") * kl).where(F.col("evidence") >= least).orderBy(F.desc("evidence"), "word").limit(FEATURES)
        vocabulary = sorted(r["word"] for r in telling.select("word").collect())
        stems = {k: [w[:-1] for w in vocabulary if w.endswith("*") and len(w) == k + 1] for k in BEGINNINGS}
        alike = reduce(lambda c, k: c | F.substring("word", 1, k).isin(*stems[k]), [k for k in BEGINNINGS if stems[k]], F.lit(False))
        near = per.where((F.col("n") >= LEAST_TEXTS) & alike & ~F.col("word").isin(*vocabulary)).orderBy(F.desc("n"), "word").limit(FEATURES)
        telling_n = len(vocabulary)
        vocabulary += sorted(r["word"] for r in near.select("word").collect()) if any(stems.values()) else []
        number = {w: i for i, w in enumerate(vocabulary)}
        told = F.array_intersect("words", F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>"))
        known = rows.select("id", "grade", "half", told.alias("words")).orderBy("id").collect()
        x, y = np.zeros((len(known), len(vocabulary)), dtype=np.float32), np.array([r["grade"] for r in known])
        for i, r in enumerate(known):
            x[i, [number[w] for w in r["words"]]] = 1
        if top == 2 and vocabulary:
            severe = _severe(rows, x[:, :telling_n], y > 0, np.array([r["half"] for r in known]), vocabulary[:telling_n], least)
            y[np.isin([r["id"] for r in known], severe)] = 2
            top = int(y.max()) + 1
    finally:
        rows.unpersist()
    w, cuts = fit_ordinal(x, y, top, PENALTY, higher=HIGHER)
    return Ordinal({v: float(k) for v, k in zip(vocabulary, w) if k}, tuple(map(float, cuts)))


def _score(batches: Iterator[pa.RecordBatch], model: Ordinal) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        p = [model.score(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.list_(pa.float64()))], names=["id", "p"])


def score(spark: SparkSession, docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, severity (the expected grade), grade (the cuts that are passed with a
    probability of one half or more), toxic (grade above 0), probabilities (of each cut).

    Null and empty texts have no words.  Rows that repeat an id are scored each.  Other columns are not read.
    """
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    p = rows.mapInArrow(lambda it: _score(it, model), "id long, p array<double>")
    grade = F.size(F.filter("p", lambda x: x >= 0.5))
    return p.select(F.col("id").alias(id_col), F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("severity"), grade.alias("grade"), (grade > 0).alias("toxic"), F.col("p").alias("probabilities"))


def toxic_grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades 0 and 1 from the label toxic."""
    return labels.where("toxic is not null").select(id_col, (F.col("toxic") > 0).cast("int").alias("grade"))
