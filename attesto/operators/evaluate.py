"""Scores, rates and significance of logged outcomes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as S
from ..shipping import ship

#: Rows up to this many are put in order in one task; more are dealt to ranges first.
ORDERED_ROWS = 100_000


def below(df: DataFrame, order: str, columns: list[str], *by: str, most: int = ORDERED_ROWS) -> DataFrame:
    """Adds ``below_c`` for each column c: its sum over the rows of smaller ``order`` (a number that no two rows of a group
    share), by groups.  Beyond ``most`` rows the values are cut into ranges at quantiles: each range is summed by
    itself, and what stands below it comes from the ranges' totals, of which there are few."""
    n = df.count()
    before = lambda w: [F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"below_{c}") for c in columns]
    if n <= most:
        return df.select("*", *before(Window.partitionBy(*by).orderBy(order)))
    cuts = sorted(set(df.approxQuantile(order, [i / (n // most + 1) for i in range(1, n // most + 1)], 0.001)))
    x = df.withColumn("__r", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))))
    totals = x.groupBy(*by, "__r").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    w = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__r", *(F.coalesce(F.sum(f"__{c}").over(w), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = x.select("*", *before(Window.partitionBy(*by, "__r").orderBy(order)))
    joined = inside.join(offsets, [*by, "__r"])
    return joined.select(*df.columns, *((F.col(f"below_{c}") + F.col(f"__{c}")).alias(f"below_{c}") for c in columns))


def rates(df: DataFrame, hit: Column, *by: str, digits: int = 6) -> DataFrame:
    """k, n, rate and the Wilson interval of a condition; rows where it is null are left out."""
    counts = df.where(hit.isNotNull()).groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return counts.select(*by, "k", "n", F.round(S.rate(F.col("k"), F.col("n")), digits).alias("rate"), F.round(low, digits).alias("low"), F.round(high, digits).alias("high"))


def pooled(df: DataFrame, k: str, n: str, *by: str) -> DataFrame:
    """Rates of sums of counts: never means of rates."""
    return df.groupBy(*by).agg(F.sum(k).alias("k"), F.sum(n).alias("n")).withColumn("rate", S.rate(F.col("k"), F.col("n")))


def slices(df: DataFrame, **conditions: Column) -> DataFrame:
    """Each row once for every slice that it is in (slices may overlap)."""
    names = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())), lambda x: x.isNotNull())
    return df.withColumn("slice", F.explode(names))


def paired(a: DataFrame, b: DataFrame, key: str, correct: str = "correct", digits: int = 6) -> DataFrame:
    """One row: pairs, gained, lost, difference in percentage points, and the exact McNemar p-value."""
    x = a.select(key, F.col(correct).alias("x")).join(b.select(key, F.col(correct).alias("y")), key)
    c = x.agg(F.count("*").alias("pairs"), F.count_if(~F.col("x") & F.col("y")).alias("gained"), F.count_if(F.col("x") & ~F.col("y")).alias("lost"))
    return c.select("pairs", "gained", "lost", F.round(F.try_divide(100.0 * (F.col("gained") - F.col("lost")), F.col("pairs")), digits).alias("points"), F.round(S.mcnemar(F.col("gained"), F.col("lost")), digits).alias("p"))


def latency(df: DataFrame, value: str, *by: str, digits: int = 6) -> DataFrame:
    """Count, mean, interpolated median and 95th percentile, extremes."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.percentile(value, 0.5), digits).alias("p50"), F.round(F.percentile(value, 0.95), digits).alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"))


def nearest_rank(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Percentiles that are values of the data."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The element at n // 2 of the ascending values, from counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    x = below(counts, value, ["c"], *by).join(counts.groupBy(*by).agg(F.sum("c").alias("n")), list(by))
    middle = F.floor(F.col("n") / 2)
    return x.where((F.col("below_c") <= middle) & (middle < F.col("below_c") + F.col("c"))).select(*by, F.col(value).alias("upper_median"))


def confusion(df: DataFrame, gold: str, said: str, labels: list) -> DataFrame:
    """Counts of each pair of labels, zeros included, and precision, recall and F1 of the gold label's class."""
    grid = [F.count_if((F.col(gold) == g) & (F.col(said) == p)).alias(f"n_{g}_{p}") for g in labels for p in labels]
    c = df.agg(*grid)
    rows = []
    for g in labels:
        tp = F.col(f"n_{g}_{g}")
        col, row = reduce(Column.__add__, [F.col(f"n_{x}_{g}") for x in labels]), reduce(Column.__add__, [F.col(f"n_{g}_{x}") for x in labels])
        p, r = F.coalesce(S.rate(tp, col), F.lit(0.0)), F.coalesce(S.rate(tp, row), F.lit(0.0))
        rows.append(F.struct(F.lit(g).alias("label"), row.alias("support"), tp.alias("hits"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1")))
    return c.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def reliability(df: DataFrame, p: str, hit: Column, bins: int = 10, digits: int = 6) -> DataFrame:
    """Equal bins of confidence, the last one closed: count, mean confidence, share of hits."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), digits).alias("confidence"), F.round(F.avg(hit.cast("double")), digits).alias("accuracy"))


def calibration(df: DataFrame, p: str, hit: Column, bins: int = 10, digits: int = 6) -> DataFrame:
    """One row: Brier score, log-loss, expected calibration error, and ROC-AUC by mean ranks."""
    y = hit.cast("double")
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    x = df.select(F.col(p).alias("p"), y.alias("y"), (-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("loss"), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin"))
    basic = x.agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg("loss").alias("log_loss"), F.sum("y").alias("ones"))
    ece = x.groupBy("bin").agg(F.count("*").alias("c"), F.abs(F.avg("p") - F.avg("y")).alias("gap")).agg(F.sum(F.col("c") * F.col("gap")).alias("gaps"))
    # Mean ranks from counts of distinct scores, so that rows never meet in one window.
    scores = x.groupBy("p").agg(F.count("*").alias("c"), F.sum("y").alias("pos"))
    ranks = below(scores, "p", ["c"]).agg(F.sum(F.col("pos") * (F.col("below_c") + (F.col("c") + 1) / 2)).alias("ranks"))
    one = basic.join(F.broadcast(ece)).join(F.broadcast(ranks))
    auc = F.try_divide(F.col("ranks") - F.col("ones") * (F.col("ones") + 1) / 2, F.col("ones") * (F.col("n") - F.col("ones")))
    return one.select("n", F.round("brier", digits).alias("brier"), F.round("log_loss", digits).alias("log_loss"), F.round(F.col("gaps") / F.col("n"), digits).alias("ece"), F.round(auc, digits).alias("auc"))


def split_halves(df: DataFrame, key: str, *by: str) -> DataFrame:
    """dev and test by turns, in the order of the ids' SHA-1 within each stratum.  The first digits of the hash make ranges of
    equal size; places are counted within a range, after the rows of the ranges before it."""
    h, part = f"__h_{key}", f"__part_{key}"
    x = df.withColumn(h, F.sha1(F.col(key).cast("string"))).withColumn(part, F.substring(h, 1, 3))
    sizes = x.groupBy(*by, part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*by, part).orderBy(h, key)) + F.col("__before")
    return x.join(offsets, [*by, part]).withColumn("split", F.when(place % 2 == 1, "dev").otherwise("test")).drop(h, part, "__before")


def islands(df: DataFrame, hit: Column, order: list[str], *by: str) -> DataFrame:
    """Runs of consecutive rows with a condition: first and last of each, and its length."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = df.withColumn("__hit", hit).withColumn("__group", F.row_number().over(w) - F.sum(F.when(hit, 1).otherwise(0)).over(w))
    kept = run.where("__hit")
    return kept.groupBy(*by, "__group").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).drop("__group")


def macro_report(df: DataFrame, gold: str, said: str, labels: list, digits: int = 6) -> DataFrame:
    """One row: n, accuracy, and the mean F1 of the labels that occur."""
    per = confusion(df, gold, said, labels)
    macro = per.agg(F.sum("support").alias("n"), F.sum("hits").alias("hits"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"))
    return macro.select("n", F.round(S.rate(F.col("hits"), F.col("n")), digits).alias("accuracy"), F.round("macro_f1", digits).alias("macro_f1"))


#: Status that a gold label asks for: fixed values.
EXPECTED_STATUS = {"entailment": "verified", "neutral": "unverified", "contradiction": "contradiction"}


def decision_shares(label: Column, status: Column, digits: int = 6) -> list[Column]:
    """Aggregates of verdicts (status) on pairs with a gold label: what is caught of the bad ones, what of the good ones is
    rejected, and how often the status is the expected one.  Shares of nothing are null."""
    ok = status == "verified"
    expected = F.coalesce(*(F.when(label == g, F.lit(s)) for g, s in EXPECTED_STATUS.items()))
    share = lambda hit, of, name: F.round(F.try_divide(F.count_if(hit & of).cast("double"), F.count_if(of)), digits).alias(name)
    return [
        F.count("*").alias("n"), share(~ok, label != "entailment", "catch_rate"), share(~ok, label == "contradiction", "contradiction_catch_rate"),
        share(~ok, label == "neutral", "neutral_catch_rate"), share(status == "contradiction", label == "contradiction", "named_contradiction"),
        share(~ok, label == "entailment", "false_rejection"), share(status == expected, F.lit(True), "agreement"),
    ]


def status_matrix(df: DataFrame, label: str, status: str) -> DataFrame:
    """(label, status, n) for every pair, zeros included."""
    statuses = ["verified", "unverified", "contradiction"]
    grid = [F.struct(F.lit(g).alias("label"), F.lit(s).alias("status"), F.count_if((F.col(label) == g) & (F.col(status) == s)).alias("n")) for g in EXPECTED_STATUS for s in statuses]
    return df.agg(F.array(*grid).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def two_axis_sweep(df: DataFrame, e: str, c: str, label: str, es: list[float], cs: list[float], strong: float | None = None, digits: int = 6) -> DataFrame:
    """(entailment, contradiction, catch_rate, false_rejection) of the rule for one source over a grid of two thresholds;
    pairs without a score are left out."""
    grid = F.array(*(F.struct(F.lit(float(x)).alias("entailment"), F.lit(float(y)).alias("contradiction")) for x in es for y in cs))
    x = df.where(F.col(e).isNotNull()).withColumn("g", F.explode(grid)).select("g.*", F.col(e).alias("e"), F.col(c).alias("c"), F.col(label).alias("label"))
    yes = (F.col("e") > F.col("entailment")) | (F.lit(strong is not None) & (F.col("e") >= F.lit(strong if strong is not None else 0.0)))
    status = F.when(F.col("c") >= F.col("contradiction"), "contradiction").when(yes, "verified").otherwise("unverified")
    shares = {a: s for s, a in zip(decision_shares(F.col("label"), F.col("status"), digits), ("n", "catch_rate", "x1", "x2", "x3", "false_rejection", "x4"))}
    g = x.withColumn("status", status).groupBy("entailment", "contradiction")
    return g.agg(shares["catch_rate"].alias("catch_rate"), shares["false_rejection"].alias("false_rejection"))


def defined_means(df: DataFrame, columns: list[str], *by: str, digits: int = 6) -> DataFrame:
    """(by, metric, mean, defined, undefined): means over the rows where a metric is defined, and how many those are."""
    stats = [F.struct(F.lit(c).alias("metric"), F.round(F.avg(c), digits).alias("mean"), F.count(c).alias("defined"), (F.count("*") - F.count(c)).alias("undefined")) for c in columns]
    return df.groupBy(*by).agg(F.array(*stats).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")


def peaks(df: DataFrame, metrics: list[str], *by: str, digits: int = 6) -> DataFrame:
    """(metric, by, peak, mean) of metrics that stand in columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x")
    return df.select(*by, pairs).groupBy("x.metric", *by).agg(F.max("x.v").alias("peak"), F.round(F.avg("x.v"), digits).alias("mean"))


#: P(0), P(0) + P(1), ... of a Poisson variable of mean 1.
POISSON = np.cumsum([np.exp(-1) / factorial(k) for k in range(12)])
#: Rows whose draws of all rounds are there at once.
DRAWN = 1024


def poisson_draws(keys: np.ndarray, rounds: int) -> np.ndarray:
    """How often each row (a 64-bit hash) is drawn in each round: rows by rounds, the same wherever it is worked out."""
    x = keys.astype(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")


def _resampled(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (hash, difference): for each round, the sums of draws and of drawn differences."""
    weights, values = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64)
    for batch in batches:
        keys, d = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for i in range(0, len(keys), DRAWN):
            w = poisson_draws(keys[i : i + DRAWN], rounds)
            weights += w.sum(axis=0)
            values += d[i : i + DRAWN].astype(np.int64) @ w
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), pa.array(weights), pa.array(values)], names=["round", "w", "d"])


def bootstrap_difference(df: DataFrame, key: str, x: str, y: str, rounds: int = 1000, seed: str = "b", digits: int = 6) -> DataFrame:
    """One row: difference of two runs' shares in percentage points, and the 2.5th and 97.5th percentile of it over resamples.

    A row's weight in a round is a Poisson draw by the hash of its key and the round, the same whenever it is made.  A task
    draws for its rows as a matrix and sends a sum for each round, so no row travels or is copied.  Rows where a run's
    outcome is null are left out.
    """
    ship(df.sparkSession)
    d = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("k"), (F.col(x).cast("int") - F.col(y).cast("int")).alias("d")).where("d is not null")
    sums = d.mapInArrow(lambda it: _resampled(it, rounds), "round long, w long, d long")
    r = sums.groupBy("round").agg(F.try_divide(100.0 * F.sum("d"), F.sum("w")).alias("points"))
    low, high = F.percentile("points", 0.025), F.percentile("points", 0.975)
    one = d.agg(F.round(100.0 * F.avg("d"), digits).alias("points"))
    return one.crossJoin(F.broadcast(r.agg(F.round(low, digits).alias("low"), F.round(high, digits).alias("high"))))


def fitted_curve(df: DataFrame, score: str, label: str, how: str):
    """Adds calibrated: the probability of the label by the score's logit, with one factor (temperature) or a factor and a
    constant (platt)."""
    if how not in ("temperature", "platt"):
        raise ValueError("how is 'temperature' or 'platt'")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = df.withColumn("__z", S.logit(F.col(score))).withColumn("__y", F.col(label).cast("double"))
    x = VectorAssembler(inputCols=["__z"], outputCol="__f").transform(x)
    model = LogisticRegression(featuresCol="__f", labelCol="__y", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c", fitIntercept=how == "platt", standardization=False).fit(x)
    return model.transform(x).withColumn("calibrated", vector_to_array("__p")[1]).drop("__z", "__y", "__f", "__p", "__r", "__c")
