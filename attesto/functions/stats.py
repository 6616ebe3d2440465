"""Statistics as Column expressions; undefined values are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(k: Column, n: Column) -> Column:
    return F.try_divide(k.cast("double"), n)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share, within [0, 1]."""
    p, z2 = k.cast("double") / F.nullif(n, F.lit(0)), z * z
    centre, scale = p + z2 / (2 * n), 1 + z2 / n
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / scale)), F.when(n > 0, F.least(F.lit(1.0), (centre + half) / scale))


def mcnemar(b: Column, c: Column) -> Column:
    """The two-sided exact p-value of discordant counts; terms are built by ratio from 2**-n, in logarithms."""
    n, m = b + c, F.least(b, c)
    terms = F.aggregate(
        F.sequence(F.lit(0), F.greatest(m, F.lit(0)).cast("int")),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))).alias("log"),
            (s["sum"] + F.exp(F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))))).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))))


def binary(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Measures of a filter from its four counts; a share of nothing is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r, s, v = share(tp, tp + fp), share(tp, tp + fn), share(tn, tn + fp), share(tn, tn + fn)
    f1, f0 = share(2 * p * r, p + r), share(2 * v * s, v + s)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {"precision": p, "recall": r, "specificity": s, "f1": f1, "macro_f1": (f1 + f0) / 2, "balanced_accuracy": (r + s) / 2, "mcc": share((tp * tn - fp * fn).cast("double"), root)}


def kappa(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Agreement beyond chance of two yes/no raters: ``both`` equal judgements, a and b yes counts."""
    observed = both.cast("double") / F.nullif(n, F.lit(0))
    expected = (a.cast("double") * b + (n - a).cast("double") * (n - b)) / F.nullif(n.cast("double") * n, F.lit(0.0))
    return F.when(expected != 1, (observed - expected) / (1 - expected))
