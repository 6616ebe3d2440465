"""Benchmark passages inside documents: size-partitioned MinHash containment search, verified on exact shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .shingles import shingle_set, utf8, words_of
from .workspace import Workspace, slices, small_batches

#: Shingles of the items that are searched for in one pass over the documents (16 MB of hashes); a larger benchmark
#: takes several passes.
BLOCK_SHINGLES = 2_000_000
#: Values of an item's sketch that a document must hold, where the item is large enough.
HITS = 4
_FILTER_BITS = 20
_U = np.uint64


class Partition:
    """The index of the items of 2**p to 2**(p + 1) - 1 shingles.

    An item's sketch is its smallest MinHash values: as many as may be missing from a document that holds the demanded
    share, plus HITS (fewer for small items).  Such a document holds HITS of them, and has at least the demanded
    share of 2**p shingles; a smaller one isn't held against this partition, one with fewer hits isn't a candidate.
    So each partition has its own sketch size and thresholds, and none overlooks an item.
    """

    def __init__(self, p: int, numbers: list[int], sets: list[np.ndarray], percent: int) -> None:
        demanded = lambda n: -(-percent * n // 100)
        self.least, self.numbers = demanded(1 << p), np.array(numbers)
        sizes = [min(len(sets[i]), len(sets[i]) - demanded(len(sets[i])) + HITS) for i in numbers]
        self.hits = np.array([k - (len(sets[i]) - demanded(len(sets[i]))) for k, i in zip(sizes, numbers)])
        values = np.concatenate([sets[i][:k] for k, i in zip(sizes, numbers)])  # sets are sorted
        owner = np.repeat(np.arange(len(numbers)), sizes)
        order = np.argsort(values, kind="stable")
        self.values, first = np.unique(values[order], return_index=True)
        self.owners, self.bounds = owner[order], np.append(first, len(order))

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        """The numbers of items whose sketches are met often enough by the shingles."""
        at = np.searchsorted(self.values, shingles)
        at[at == len(self.values)] = 0
        met = at[self.values[at] == shingles]
        if not len(met):
            return met
        first, size = self.bounds[met], self.bounds[met + 1] - self.bounds[met]
        places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        found, times = np.unique(self.owners[places], return_counts=True)
        return self.numbers[found[times >= self.hits[found]]]


class Items:
    """A block of test items, in partitions by size."""

    def __init__(self, names: list[int], sets: list[np.ndarray], percent: int) -> None:
        self.names, self.sets, self.percent = names, sets, percent
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            by_size.setdefault(len(s).bit_length() - 1, []).append(i)
        self.partitions = [Partition(p, numbers, sets, percent) for p, numbers in sorted(by_size.items())]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        for part in self.partitions:
            self.filter[(part.values & _U((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def inside(self, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, those shared) of the items that a document's set contains."""
        some = shingles[self.filter[(shingles & _U((1 << _FILTER_BITS) - 1)).astype(np.int64)]]
        out = []
        for part in self.partitions:
            if len(shingles) < part.least or not len(some):
                break  # later partitions ask for more
            for item in part.candidates(some):
                own = self.sets[item]
                place = np.searchsorted(shingles, own)
                place[place == len(shingles)] = 0
                shared = int((shingles[place] == own).sum())
                if 100 * shared >= self.percent * len(own):
                    out.append((self.names[item], len(own), shared))
        return out


def _search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(doc, *x) for doc, w in zip(batch.column(0).to_pylist(), words_of(*utf8(batch.column(1)))) for x in items.inside(shingle_set(w))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["id", "item", "n", "shared"])


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(w).tobytes() for w in words_of(*utf8(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["item", "s"])


def _blocks(sets: DataFrame, percent: int) -> Iterator[Items]:
    """The items in blocks; one block and one part of the table are in the driver at a time."""
    names, held, size = [], [], 0
    for row in sets.toLocalIterator():
        if len(row["s"]):
            names.append(row["item"])
            held.append(np.frombuffer(row["s"], _U))
            size += len(held[-1])
        if size >= BLOCK_SHINGLES:
            yield Items(names, held, percent)
            names, held, size = [], [], 0
    if names:
        yield Items(names, held, percent)


def contained_items(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """Rows (``id_col``, ``item_col``, n_item_shingles, n_shared): each pair of a document and a test item of whose
    distinct five-word shingles the document holds ``percent`` of 100 or more.

    The benchmark comes in blocks of bounded size, each searched for in one pass over the documents, whose result is
    written before the next block is made; rows stay where they are read.  An item of fewer than five words is one
    shingle, which only a document of just these words has.  Null or empty texts, and items without a number, match
    nothing; repeated rows give repeated pairs; documents with a null id give pairs with a null id.  Other columns
    are not read.
    """
    ship(spark)
    ws = Workspace(spark, "contained")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item is not null")
    sets = ws.save(items.mapInArrow(_item_sets, "item long, s binary"), "items")
    kind = "id long, item long, n long, shared long"
    blocks = 0
    for block in _blocks(sets, percent):
        sent = spark.sparkContext.broadcast(block)  # of bounded size
        with small_batches(spark):
            rows.mapInArrow(lambda it, b=sent: _search(it, b.value), kind).write.parquet(f"{ws.path}/found/block={blocks}")
        sent.destroy()
        blocks += 1
    out = spark.read.schema(kind).parquet(f"{ws.path}/found") if blocks else spark.createDataFrame([], kind)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n").alias("n_item_shingles"), F.col("shared").alias("n_shared"))
