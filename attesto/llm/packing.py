"""Hierarchical packing of token sequences into context windows of several lengths."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .encoders import token_ids
from .workspace import slices

#: Context lengths, longest first.
TIERS = (1024, 512, 256, 128)
#: Ids packed together in a task; bounds its memory.
BLOCK_IDS = 1 << 20
#: Ids of a training step's group of windows of one tier.
STEP_IDS = 1 << 16


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (length, [(document, start, length)]) that hold every token of documents of these sizes once.

    A document fills windows of the longest tier; its rest goes to the smallest tier that holds it.  From the longest
    tier down, the longest rest opens a window; the gap takes the longest shorter rests that fit whole, then the
    start of one that doesn't, so a window stays open only when no token is left.  That last one is cut into
    powers of two: there is no padding.
    """
    longest, out = tiers[0], []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for doc, n in enumerate(sizes):
        out.extend((longest, [(doc, at, longest)]) for at in range(0, n - longest + 1, longest))
        if rest := n % longest:
            pool.append((rest, doc, n - rest))
    pool.sort()
    last: list[tuple[int, int, int]] = []
    for tier, shorter in zip(tiers, [*tiers[1:], 0]):
        while pool and pool[-1][0] > shorter:
            n, doc, at = pool.pop()
            window, gap = [(doc, at, n)], tier - n
            while gap and pool:
                k = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if k >= 0:
                    n, doc, at = pool.pop(k)
                    window.append((doc, at, n))
                    gap -= n
                else:  # no rest fits whole: the shortest one is cut, and what is left of it goes back
                    n, doc, at = pool.pop(0)
                    window.append((doc, at, gap))
                    insort(pool, (n - gap, doc, at + gap))
                    gap = 0
            if gap:
                last = window
            else:
                out.append((tier, window))
    total = sum(n for _, _, n in last)
    while last:
        size = 1 << (total.bit_length() - 1)
        window, room = [], size
        while room:
            doc, at, n = last.pop(0)
            take = min(n, room)
            window.append((doc, at, take))
            room -= take
            if take < n:
                last.insert(0, (doc, at + take, n - take))
        out.append((size, window))
        total -= size
    return out


def step_groups(windows: list[tuple[int, list]], step_ids: int = STEP_IDS) -> list[int]:
    """A step group for each window: those of a group have one length and, but for the last group of a length, equal
    numbers of ids; dealt there and back by their numbers of pieces, so groups hold about as many documents."""
    out, first = [0] * len(windows), 0
    by_length: dict[int, list[int]] = {}
    for i, (length, _) in enumerate(windows):
        by_length.setdefault(length, []).append(i)
    for length in sorted(by_length, reverse=True):
        order = sorted(by_length[length], key=lambda i: (-len(windows[i][1]), i))
        groups = -(-len(order) * length // step_ids)
        for rank, i in enumerate(order):
            lap, at = divmod(rank, groups)
            out[i] = first + (at if lap % 2 == 0 else groups - 1 - at)
        first += groups
    return out


_SCHEMA = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("context", pa.int32()), ("step_group", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, part = token_ids(tokenizer).encode, TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    docs: list = []
    held, sequence, group = 0, part << 40, part << 40

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal docs, held, sequence, group
        windows = pack([len(x) // 4 for _, x in docs])
        groups, rows = step_groups(windows), []
        for (length, pieces), g in zip(windows, groups):
            offset = 0
            for doc, start, n in pieces:
                name, ids = docs[doc]
                rows.append((name, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, sequence, offset, length, group + g))
                offset += n
            sequence += 1
        group += max(groups, default=-1) + 1
        docs, held = [], 0
        for i in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 512]), _SCHEMA)], schema=_SCHEMA)

    for batch in slices(batches):
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = encode(text) + end
            docs.append((name, ids))
            held += len(ids) // 4
            if held >= BLOCK_IDS:
                yield from flush()
    if docs:
        yield from flush()


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (little-endian 32-bit integers), doc_tokens, sequence_id,
    offset, context (the window's length), step_group.

    A document is its ids and ``end_id``.  Each task packs its own documents in blocks of BLOCK_IDS ids, as read:
    no row is shuffled, and a repeated task makes the same windows.  The numbers of sequences and of step groups
    are those of the task's partition (times 2**40) plus a count.  Null and empty texts are ``end_id`` alone.
    Rows that repeat an id, or have none, are packed as documents of their own.  Other columns are not read.
    """
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = rows.mapInArrow(lambda it: _pack(it, tokenizer, end_id), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context int, step_group long")
    return packed.withColumnRenamed("id", id_col)
