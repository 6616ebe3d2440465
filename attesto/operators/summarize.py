"""Selection of passages that are relevant and differ, removal of what repeats, and summaries of summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..shipping import ship
from ..storage import Workspace


def equidistant(df: DataFrame, size: int, order: str, *by: str) -> DataFrame:
    """``size`` rows of each group at equal distances by order, ends included; all of a smaller group."""
    w = Window.partitionBy(*by)
    x = df.withColumn("__r", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (size - 1)).cast("int"))
    return x.where((F.col("__n") <= size) | F.array_contains(spots, F.col("__r"))).drop("__r", "__n")


def centroid_relevance(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """Adds relevance: the cosine of each vector with the mean of its group.  The mean is made by dimension, partly in
    each task, so groups of any size pass."""
    x = df.select(*by, F.posexplode(vector).alias("__i", "__x"))
    mean = x.groupBy(*by, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    centre = mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("__centre"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    v, c = F.col(vector), F.col("__centre")
    return df.join(centre, list(by)).withColumn("relevance", F.try_divide(dot(v, c), F.sqrt(dot(v, v) * dot(c, c)))).drop("__centre")


def mmr(vectors: np.ndarray, relevance: np.ndarray, limit: int = 12, weight: float = 0.6, duplicate: float = 0.85) -> list[int]:
    """Rows picked one by one for weight * relevance - (1 - weight) * largest similarity to those picked; rows more
    similar than ``duplicate`` to one picked are out.  Ties go to the earlier row."""
    if limit < 1 or not 0 <= weight <= 1 or not 0 <= duplicate <= 1 or len(vectors) != len(relevance):
        raise ValueError("invalid selection")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near, open_, out = np.zeros(len(unit)), np.ones(len(unit), dtype=bool), []
    while open_.any() and len(out) < limit:
        score = np.where(open_, weight * relevance - (1 - weight) * near, -np.inf)
        best = int(np.argmax(score))
        out.append(best)
        similar = np.clip(unit @ unit[best], -1, 1)
        near = np.maximum(near, similar) if len(out) > 1 else similar
        open_ &= similar <= duplicate
        open_[best] = False
    return out


def distinct_by_similarity(vectors: np.ndarray, threshold: float = 0.85) -> list[int]:
    """Rows, in order, that are no more similar than the threshold to a kept one."""
    unit, kept = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), []
    for i, v in enumerate(unit):
        if not kept or (unit[kept] @ v).max() <= threshold:
            kept.append(i)
    return kept


def mmr_by_group(pool: DataFrame, key: str, vector: str, by: str, limit: int = 12) -> DataFrame:
    """(by, key, rank): the selection in each group of a pool that ``equidistant`` has bounded."""

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        v = np.array(table.column(vector).to_pylist(), dtype=np.float64)
        chosen = mmr(v, table.column("relevance").to_numpy(), limit)
        return pa.table({by: table.column(by).take(chosen), key: table.column(key).take(chosen), "rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    kinds = dict(pool.dtypes)
    return pool.select(by, key, vector, "relevance").groupBy(by).applyInArrow(pick, f"{by} {kinds[by]}, {key} {kinds[key]}, rank int")


def first_of_repeats(df: DataFrame, text: str, order: list[str], *by: str, exempt: Column | None = None) -> DataFrame:
    """Rows whose normalised text didn't come before in its group; exempt rows stay."""
    key = T.normalize(text)
    r = F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))
    keep = (r == 1) if exempt is None else (r == 1) | exempt
    return df.withColumn("__keep", keep).where("__keep").drop("__keep")


def paragraphs(df: DataFrame, order: str, by: str, most: int = 3) -> DataFrame:
    """Adds paragraph: rows of a group in order, spread over at most ``most`` paragraphs."""
    w = Window.partitionBy(by)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    return df.withColumn("paragraph", F.floor(i * F.least(F.lit(most), n) / n).cast("int"))


def distinct_by_group(df: DataFrame, key: str, vector: str, by: str, order: str, threshold: float = 0.85) -> DataFrame:
    """(by, key): rows of each group, in order, that are no more similar than the threshold to a kept one.  Groups are pools
    that ``equidistant`` has bounded."""

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        kept = distinct_by_similarity(np.array(table.column(vector).to_pylist(), dtype=np.float64), threshold)
        return pa.table({by: table.column(by).take(kept), key: table.column(key).take(kept)})

    kinds = dict(df.dtypes)
    columns = list(dict.fromkeys([by, key, vector, order]))
    return df.select(*columns).groupBy(by).applyInArrow(pick, f"{by} {kinds[by]}, {key} {kinds[key]}")


def batches_of(items: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Adds batch: items of a group in order, as many together as the budget holds; an item that is larger is an error.  The fold
    runs over a group's sizes, a number each."""
    g = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n")))).alias("s"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("all"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] + x["n"] <= budget) | (a["used"] == 0)
        b = F.when(fits, a["b"]).otherwise(a["b"] + 1)
        return F.struct(b.alias("b"), F.when(fits, a["used"] + x["n"]).otherwise(x["n"]).alias("used"), F.concat(a["all"], F.array(b)).alias("all"))

    flat = g.select(by, F.posexplode(F.arrays_zip("s", F.aggregate("s", start, step, lambda a: a["all"]).alias("b"))).alias("i", "z"))
    too_large = F.when(F.col("z.s.n") > budget, F.raise_error(F.lit("an item exceeds the budget"))).otherwise(F.col("z.b"))
    return items.join(flat.select(by, F.col("z.s.o").alias(order), too_large.alias("batch")), [by, order])


def map_reduce(items: DataFrame, by: str, order: str, text: str, size: Callable[[Column], Column], write: Callable[[Column], Column], budget: int, calls: int = 16) -> DataFrame:
    """(by, text): one text for each group, made by ``write`` (a caller's model) from joined texts: batches that the budget
    holds, then batches of what came out, until one is left.  Each round is one pass over all groups that aren't done; a
    group that would need more than ``calls`` is an error, not a part of its texts."""
    left = items.select(by, F.col(order).cast("long").alias("o"), F.col(text).alias("t"), F.lit(0).alias("calls"))
    done = None
    while True:
        x = batches_of(left.withColumn("n", size(F.col("t"))), by, "o", "n", budget)
        made = x.groupBy(by, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda s: s["t"]), "\n").alias("t"), F.max("calls").alias("before"))
        n = made.groupBy(by).agg(F.count("*").alias("batches"))
        y = made.join(n, by).withColumn("calls", F.col("before") + F.col("batches"))
        y = y.withColumn("calls", F.when(F.col("calls") > calls, F.raise_error(F.lit("the calls of a summary are used up"))).otherwise(F.col("calls")))
        y = y.select(by, F.col("batch").cast("long").alias("o"), write(F.col("t")).alias("t"), "calls", "batches")
        y = Workspace(items.sparkSession, "summary").save(y, "round")
        ready = y.where("batches = 1").select(by, F.col("t").alias("text"))
        done = ready if done is None else done.unionByName(ready)
        left = y.where("batches > 1").select(by, "o", "t", "calls")
        if left.isEmpty():
            return done


#: Windows of a group that meet its claims in one task, and claims whose similarities are there at once.
WINDOWS, CLAIMS = 1 << 14, 256


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    m = np.array(vectors.to_pylist(), dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1)[:, None]


def _best_of(claims: pa.Table, windows: pa.Table) -> tuple[list[int], list[int], list[float]]:
    """(claim, window, similarity): the best window of each claim, the first one on ties."""
    place: dict[str, list[int]] = {}
    for i, name in enumerate(windows.column("source_id").to_pylist()):
        place.setdefault(name, []).append(i)
    cited, u, v = claims.column("cited").to_pylist(), _units(claims.column("u")), _units(windows.column("v"))
    rows: list[int] = []
    best: list[int] = []
    near: list[float] = []
    for a in range(0, len(u), CLAIMS):
        product = np.round(u[a : a + CLAIMS] @ v.T, 9) + 0.0
        for k, row in enumerate(product, a):
            at = np.sort(np.array([i for name in {*cited[k]} for i in place.get(name, ())], dtype=np.int64)) if cited[k] else None
            if at is None or len(at):
                best.append(int(row.argmax() if at is None else at[row[at].argmax()]))
                rows.append(k)
                near.append(float(row[best[-1]]))
    return rows, best, near


def nearest_windows(claims: DataFrame, windows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, s, w, source_id, c): the most similar window of each claim, among the sources that it cites, or among all if
    it cites none; the earliest on ties, of those the one of the last source by name.

    A group's windows are dealt to parts of some ``WINDOWS``; each part meets all claims of its group as a product of
    matrices and gives its best window for each claim, so no pair leaves a task, however many windows a group has.
    """
    ship(claims.sparkSession)
    parts = windows.groupBy(by).agg(F.ceil(F.count("*") / WINDOWS).cast("int").alias("parts"))
    w = windows.select(by, "source_id", "w", "vector", F.col("c").cast("double").alias("c")).join(parts, by)
    w = w.withColumn("part", F.pmod(F.xxhash64("source_id", "w"), F.col("parts")).cast("int")).drop("parts")
    c = claims.select(by, order, "vector", "source_ids").join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # Both sides may come from one table: their columns get names of their own.
    c, w = c.toDF("g", "o", "u", "cited", "k"), w.toDF("wg", "source_id", "w", "v", "c", "wk")

    def run(claims: pa.Table, windows: pa.Table) -> pa.Table:
        windows = windows.sort_by([("w", "ascending"), ("source_id", "descending")])
        rows, best, near = _best_of(claims, windows) if claims.num_rows and windows.num_rows else ([], [], [])
        of, at = claims.take(pa.array(rows, pa.int64())), windows.take(pa.array(best, pa.int64()))
        return pa.table({by: of.column("g"), order: of.column("o"), "s": pa.array(near, pa.float64()), "w": at.column("w"), "source_id": at.column("source_id"), "c": at.column("c")})

    kinds = {**dict(claims.dtypes), "w": dict(windows.dtypes)["w"]}
    found = c.groupBy("g", "k").cogroup(w.groupBy("wg", "wk")).applyInArrow(run, f"{by} {kinds[by]}, {order} {kinds[order]}, s double, w {kinds['w']}, source_id string, c double")
    best = found.groupBy(by, order).agg(F.max(F.struct("s", (-F.col("w")).alias("n"), "source_id", "w", "c")).alias("b"))
    return best.select(by, order, "b.s", "b.w", "b.source_id", "b.c")


#: Claims that are held against the accepted ones at once, and accepted ones that they meet at once.
FOLD, ACCEPTED = 256, 1 << 13


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows; 0 for those without direction."""
    size = np.sqrt(np.outer((a * a).sum(axis=1), (b * b).sum(axis=1)))
    return np.divide(a @ b.T, size, out=np.zeros(size.shape), where=size != 0)


def _fold(vectors: np.ndarray, ok: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(near, accepted) of claims in their order: the largest similarity to an accepted one before, 0 for none, and whether a
    claim that is ``ok`` is accepted itself, as it isn't nearer than the threshold."""
    near, accepted = np.full(len(vectors), -np.inf), np.zeros(len(vectors), bool)
    kept, n = np.empty(vectors.shape), 0
    for a in range(0, len(vectors), FOLD):
        block = vectors[a : a + FOLD]
        best = near[a : a + FOLD]
        for k in range(0, n, ACCEPTED):
            best[:] = np.maximum(best, _cosines(block, kept[k : min(k + ACCEPTED, n)]).max(axis=1))
        inner = _cosines(block, block)
        for i in range(len(block)):
            best[i] = 0.0 if best[i] == -np.inf else best[i]
            if ok[a + i] and best[i] <= threshold:
                accepted[a + i] = True
                kept[n], n = block[i], n + 1
                best[i + 1 :] = np.maximum(best[i + 1 :], inner[i, i + 1 :])
    return near, accepted


def summary_claims(claims: DataFrame, windows: DataFrame, by: str, order: str, threshold: float = 0.85, contradiction: float = 0.3) -> DataFrame:
    """(by, order, source_id, similarity, status): claims of a summary (vector, source_ids) held against windows of sources
    (source_id, w, vector, c: the contradiction of a claim that is held against it, by ``nli`` of the caller).

    A claim's premise is its most similar window among the sources that it cites, or among all if it cites none, the
    earliest on ties.  Contradicted claims come first out, then those that repeat an accepted one.  The fold over a summary's
    claims holds blocks of them against the accepted ones as products of matrices.
    """
    near = nearest_windows(claims, windows, by, order)
    ok = F.coalesce(F.col("c") <= contradiction, F.lit(False))
    best = claims.select(by, order, "vector").join(near, [by, order]).select(F.col(by).alias("g"), F.col(order).alias("o"), "source_id", "vector", ok.alias("ok"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("o")
        held = rows.column("vector").to_pylist()
        vectors = np.array(held, dtype=np.float64)
        vectors[[None in v for v in held]] = 0
        good = rows.column("ok").to_numpy()
        similar, accepted = _fold(vectors, good, threshold)
        status = np.where(accepted, "accepted", np.where(good, "duplicate", "contradiction"))
        return pa.table({by: rows.column("g"), order: rows.column("o"), "source_id": rows.column("source_id"), "similarity": similar, "status": pa.array(status.tolist(), pa.string())})

    kinds = dict(claims.dtypes)
    out = best.groupBy("g").applyInArrow(run, f"{by} {kinds[by]}, {order} {kinds[order]}, source_id string, similarity double, status string")
    return out.withColumn("similarity", F.round("similarity", 6))
