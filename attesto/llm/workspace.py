"""Joins whose broadcast side is bounded, batches of bounded size, and the folder of intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Workspace, clean, hadoop_fs, remove, small_batches

__all__ = ["BROADCAST_IDS", "Workspace", "clean", "fair_share", "hadoop_fs", "join_groups", "keyed", "remove", "slices", "small_batches", "with_ids"]

#: Ids up to this many are broadcast (16 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: A group is hot if it has more rows than this share of what a task gets on average.
HOT_SHARE = 0.1
#: Rows and bytes that a Python worker handles at once.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Bytes of batches after which unused memory is given back.
RELEASE = 16 << 20


def with_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """``docs`` semi- or anti-joined with the materialised ``ids`` (one column).  Null matches null.  The ids are
    broadcast only if counted to be few; otherwise both sides are shuffled by key."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(ids["__id"]), how)


def keyed(spark: SparkSession, docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """The documents and the column that tells their rows apart: the id, or a number in the order of ids (null last),
    then of hashes of texts; rows that are alike in both get different numbers."""
    ids = docs.agg(F.count("*").alias("rows"), F.count(id_col).alias("known")).first()
    if ids["rows"] == ids["known"] and docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs, id_col
    key, hash_ = "row_key", F.xxhash64(text_col)
    while key in docs.columns:
        key = f"_{key}"
    order = [F.col(id_col).asc_nulls_last(), hash_.asc()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return Workspace(spark, name).save(dealt.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def fair_share(spark: SparkSession, rows: int) -> float:
    """The rows of a group that make it hot: ``HOT_SHARE`` of what each of the shuffle's tasks gets on average."""
    return HOT_SHARE * rows / int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner, left or left_semi) with one row per group, no task getting a hot group.

    ``size`` is the column of ``groups`` that counts a group's rows; both tables are materialised.  Groups of more
    rows than :func:`fair_share` are joined by broadcast: there are fewer of them than 1 / HOT_SHARE for each
    partition of the shuffle, whatever the data.  The rows of all others are shuffled.
    """
    hot = F.col(size) > fair_share(rows.sparkSession, rows.count())
    large = groups.where(hot)
    if large.isEmpty():
        return rows.join(groups, on, how)
    some = rows.join(F.broadcast(large), on, "left_semi" if how == "left_semi" else "inner")
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(groups.where(~hot), on, how)
    return some.unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few texts each: Spark's batches hold up to 10,000 rows or 64 MB, which a worker would
    hold several times over as Python objects.  The session's settings stay as they are.  What Arrow's pool keeps of batches
    that are gone is given back every ``RELEASE`` bytes and at the end, as workers outlive their tasks."""
    pool, read = pa.default_memory_pool(), 0
    for batch in batches:
        at, read = 0, read + batch.nbytes
        while at < batch.num_rows:
            part = batch.slice(at, SLICE_ROWS)
            while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows
        if read >= RELEASE:
            pool.release_unused()
            read = 0
    batch = part = None
    pool.release_unused()

