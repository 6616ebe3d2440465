"""Product codes of vectors: each part of a vector becomes the index of the nearest entry of that part's codebook.

All numbers are integers, so results don't depend on how rows are dealt.  A task holds the codebooks (16 entries by the
vector's length) as one vantage-point tree for each part and sends on, for each entry, how many parts it drew and their
sum; the driver gets these sums alone, added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .workspace import Workspace, join_groups

#: Bytes of integers that a task assigns at once.
GATHER = 16 << 20
#: Distances are widened by this share: far more than what rounding to doubles, roots and differences can change.
SLACK = 2.0**-48


class VantageTree:
    """The entries of one part: a node is an entry, its children the nearer and the farther half of the others, with the
    least and the greatest distance from the node to each half."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _squared(self, rows: np.ndarray, k: int) -> np.ndarray:
        off = rows - self.entries[k]
        return np.einsum("ij,ij->i", off, off)

    def _node(self, held: np.ndarray):
        if not len(held):
            return None
        vantage, others = held[0], held[1:]
        far = self._squared(self.entries[others], vantage)
        others, far = others[np.argsort(far, kind="stable")], np.sort(far)
        half = (len(others) + 1) // 2
        sides = []
        for part, reach in ((others[:half], far[:half]), (others[half:], far[half:])):
            if len(part):
                sides.append((self._node(part), np.sqrt(float(reach[0])) * (1 - SLACK), np.sqrt(float(reach[-1])) * (1 + SLACK)))
        return vantage, sides

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each row, the lower one of several, and the squared distance."""
        best = np.full(len(rows), np.iinfo(np.int64).max)
        index = np.full(len(rows), len(self.entries))
        self._visit(self.root, np.arange(len(rows)), rows, best, index)
        return index, best

    def _visit(self, node, at: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if node is None or not len(at):
            return
        vantage, sides = node
        exact = self._squared(rows[at], vantage)
        better = (exact < best[at]) | (exact == best[at]) & (vantage < index[at])
        best[at[better]], index[at[better]] = exact[better], vantage
        if not sides:
            return
        d = np.sqrt(exact.astype(np.float64))
        bound = [np.maximum(d * (1 - SLACK) - high, low - d * (1 + SLACK)) for _, low, high in sides]

        def go(side: int, which: np.ndarray) -> None:
            """A side is left out only where its least distance is surely above the best one."""
            to = at[which]
            reached = bound[side][which] <= np.sqrt(best[to].astype(np.float64)) * (1 + SLACK)
            self._visit(sides[side][0], to[reached], rows, best, index)

        if len(sides) == 1:
            return go(0, np.arange(len(at)))
        first = bound[0] <= bound[1]  # where the nearer half is the likelier one
        near, far = np.flatnonzero(first), np.flatnonzero(~first)
        go(0, near)
        go(1, np.concatenate((far, near)))
        go(0, far)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of some ``GATHER`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHER:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their parts, and for each row and part the entry and the squared distance."""
    trees = [VantageTree(book) for book in books]
    parts, _, width = books.shape
    for table in _gathered(batches):
        values = table.column("v").combine_chunks().flatten().to_numpy()
        cut = values.astype(np.int64).reshape(table.num_rows, parts, width)
        found = [tree.nearest(np.ascontiguousarray(cut[:, j])) for j, tree in enumerate(trees)]
        yield table, cut, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each entry of each part: how many parts it drew, then their sums by component."""
    parts, entries, width = books.shape
    total = np.zeros((parts, entries, 1 + width), np.int64)
    for _, cut, code, _ in _assigned(batches, books):
        for j in range(parts):
            np.add.at(total[j, :, 1:], code[:, j], cut[:, j])
            total[j, :, 0] += np.bincount(code[:, j], minlength=entries)
    cells = np.flatnonzero(total[:, :, 0].ravel())
    drawn = total.reshape(parts * entries, 1 + width)[cells]
    yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "sums": pa.array(list(drawn), pa.list_(pa.int64()))})


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for table, _, code, distance in _assigned(batches, books):
        raw = [row.tobytes() for row in code.astype(np.uint8)]
        out = table.drop_columns("v").append_column("code", pa.array(raw, pa.binary())).append_column("error", pa.array(distance.sum(axis=1)))
        yield from out.combine_chunks().to_batches()


@dataclass
class Codes:
    """``books[part, entry, position]`` and the coded rows: id, label, code (a byte for each part), error."""

    books: np.ndarray
    rows: DataFrame

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def compress_vectors(
    spark: SparkSession, rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> Codes:
    """Codebooks of the integers floor(scale * x), after ``rounds`` rounds of assignment and means, and codes by them.

    The codebooks start as the parts of the rows with the least ids (null last; of one id, the lesser vector), all of
    them if there are fewer than ``entries``.  Rows whose vector is null or holds null or non-finite components go; rows
    with null, repeated or no labels or ids stay, each for itself.  Without rows, the codebooks are empty.  Vectors of
    different lengths or of one that ``parts`` doesn't divide, and components whose squared distances a long may not
    hold, are an error.  Other columns are not read.
    """
    ship(spark)
    ws = Workspace(spark, "vector-codes")
    kept = rows.where(whole(F.col(vector_col)))
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    kept = ws.save(kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled.alias("v")), "integers")
    most = F.greatest(F.max(F.array_max("v")), -F.min(F.array_min("v")))
    seen = kept.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("length"), most.alias("most")).first()
    length = seen["length"] or 0
    if seen["least"] is not None and (seen["least"] != length or length % parts):
        raise ValueError(f"vectors of {seen['least']} to {length} components can't be cut into {parts} equal parts")
    if length and not seen["most"] <= isqrt((1 << 61) // length):
        raise ValueError(f"components of up to {seen['most'] / scale:g} are too large for exact distances")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, length // parts).swapaxes(0, 1).copy()
    for _ in range(rounds if len(first) else 0):
        drawn = kept.select("v").mapInArrow(lambda it, b=books: _sums(it, b), "cell int, sums array<long>")
        sums = drawn.select("cell", F.posexplode("sums")).groupBy("cell", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("sum"))
        held = {(r["cell"], r["pos"]): int(r["sum"]) for r in sums.collect()}  # parts * entries * (1 + width) at most
        flat = books.copy().reshape(-1, books.shape[2])
        for cell in range(len(flat)):
            if n := held.get((cell, 0)):
                flat[cell] = [held[cell, p + 1] // n for p in range(flat.shape[1])]
        books = flat.reshape(books.shape)
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = kept.mapInArrow(lambda it: _codes(it, books), f"id {types['id']}, label {types['label']}, code binary, error long")
    return Codes(books, ws.save(coded, "codes"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Coded rows with ``label_error``, the errors of all rows of a label added up; rows without a label are together."""
    keyed = coded.withColumn("__label", F.struct("label"))
    sums = keyed.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__size"))
    joined = join_groups(keyed, sums, ["__label"], "__size")
    return joined.drop("__label", "__size")
