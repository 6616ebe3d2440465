"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """Rows (id, root) for every id that has an edge; root is the smallest id of its component.

    ``edges`` has long columns a and b; loops, repeats and both directions are allowed.  Each step is one shuffle
    by id with a partial minimum before it, so an id with very many neighbours costs its task a count of partial
    rows; every step is written, which ends its lineage.  The number of steps grows with the logarithm of the
    longest chain, not with the size of components.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, k = digest(e), 0
    while True:
        k += 1
        near = both(e)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = ws.save(pairs.select("x.*").where("a <> b").distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now = digest(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
