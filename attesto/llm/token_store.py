"""Token ids in binary shards, compressed by a grammar of frequent pairs (Re-Pair)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .encoders import token_ids
from .shingles import utf8
from .workspace import slices, small_batches

#: A shard's file: magic, then as unsigned 64-bit integers the numbers of documents, ids, rules and symbols, the
#: first nonterminal and the bytes of a symbol; then the arrays in the order of ``Shard``.
MAGIC = b"RPAIR01\n"
_HEAD = struct.Struct("<8s6Q")
SHARD_IDS = 1 << 18
#: Pre-tokens that a writing worker remembers (about 260 MB); it holds nothing else of size.
MEMORY = 1_200_000
#: A pair becomes a nonterminal while it occurs this often.
LEAST_PAIRS = 8
#: Symbols between stored positions, for access at random.
STRIDE = 1024


def compress(ids: np.ndarray, first: int, limit: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules of a sequence whose ids are below ``first``; rule i is the pair that first + i stands for.

    Each round counts adjacent pairs, takes those at least a quarter as frequent as the most frequent one, and
    replaces their occurrences; of two that overlap, the more frequent pair wins, in rows of equals every other one.  Rounds go on
    until no pair occurs LEAST_PAIRS times, or symbols would reach ``limit``.  A place whose pair is rarer is left
    alone from then on, unless a replacement beside it makes a new pair there.
    """
    s, rules = ids.astype(np.int64), []
    active = np.arange(max(len(s) - 1, 0))
    bits = max(len(s), 1).bit_length()
    width = (63 - bits) // 2
    if limit > 1 << width:
        raise ValueError("the sequence is too long for its vocabulary")
    while len(active):
        whole = len(active) == len(s) - 1
        k = s[:-1].copy() if whole else s[active]
        k <<= width
        k |= s[1:] if whole else s[active + 1]
        k <<= bits
        k |= active
        k.sort()
        pair = k >> bits
        new = np.ones(len(pair), dtype=bool)
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        at = np.flatnonzero(new)
        count = np.diff(at, append=len(k))
        room = limit - first - len(rules)
        often = count >= LEAST_PAIRS
        if not often.any() or room <= 0:
            break
        least = max(LEAST_PAIRS, int(count.max()) // 4)
        chosen = count >= least
        if int(chosen.sum()) > room:
            chosen = np.zeros(len(count), dtype=bool)
            chosen[np.argsort(-count, kind="stable")[:room]] = True
        mask = (1 << bits) - 1
        alive = np.zeros(len(s), dtype=bool)
        alive[k[np.repeat(often, count)] & mask] = True
        both = k[np.repeat(chosen, count)] & mask
        both <<= bits
        both |= np.repeat(np.flatnonzero(chosen), count[chosen])
        both.sort()
        where, which = both >> bits, both & mask
        # Overlapping neighbours: in a row of equally frequent pairs every other place, else the more frequent pair.
        rank = count[which]
        along = np.zeros(len(where), dtype=bool)
        along[1:] = (where[1:] == where[:-1] + 1) & (rank[1:] == rank[:-1])
        start = np.maximum.accumulate(np.where(along, 0, np.arange(len(where))))
        even = (np.arange(len(where)) - start) % 2 == 0
        where, which, rank = where[even], which[even], rank[even]
        touch = where[1:] == where[:-1] + 1
        keep = np.ones(len(where), dtype=bool)
        keep[1:] &= ~touch | (rank[1:] > rank[:-1])
        keep[:-1] &= ~touch | (rank[:-1] >= rank[1:])
        where, which = where[keep], which[keep]
        used = np.bincount(which, minlength=len(count))
        good = used > 1  # a pair that overlaps left at most once waits; its places stay in the count
        where, which = where[good[which]], which[good[which]]
        if not len(where):
            break
        named = np.flatnonzero(good)
        name = np.zeros(len(count), dtype=np.int64)
        name[named] = first + len(rules) + np.arange(len(named))
        named_pairs = pair[at[named]]
        rules.extend(zip((named_pairs >> width).tolist(), (named_pairs & ((1 << width) - 1)).tolist()))
        s[where] = name[which]
        # What a replacement touches counts anew: the pair that ends in it, and the one that starts there.
        alive[where] = True
        alive[np.maximum(where - 1, 0)] = True
        stay = np.ones(len(s), dtype=bool)
        stay[where + 1] = False
        before = np.maximum(where - 1, 0)
        gone = before[~stay[before]]  # the place before was taken by the replacement two to the left
        alive[gone - 1] = True
        s, alive = s[stay], alive[stay]
        alive[-1] = False
        active = np.flatnonzero(alive)
    return s, np.array(rules, dtype=np.uint32).reshape(-1, 2)


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """The number of ids that each nonterminal stands for; a rule refers to earlier ones only."""
    out = np.ones(len(rules), dtype=np.int64)
    done = np.zeros(len(rules), dtype=bool)
    inner = rules.astype(np.int64) - first
    while not done.all():
        ready = ~done & (((inner < 0) | done[np.maximum(inner, 0)]).all(axis=1))
        out[ready] = np.where(inner[ready] < 0, 1, out[np.maximum(inner[ready], 0)]).sum(axis=1)
        done |= ready
    return out


class Shard:
    """Reads the bytes of one shard; nothing is expanded before it is asked for."""

    def __init__(self, blob) -> None:
        magic, self.docs, self.ids, n_rules, n_symbols, self.first, width = _HEAD.unpack_from(blob, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.null_ids = take(self.docs, "<i8"), take(self.docs, "u1")
        self.starts = take(self.docs + 1, "<u8")
        self.rules, self.lengths = take(2 * n_rules, "<u4").reshape(-1, 2), take(n_rules, "<u4")
        self.marks = take(-(-n_symbols // STRIDE), "<u8")
        self.symbols = take(n_symbols, f"<u{width}")

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        while (big := s >= self.first).any():
            at = np.flatnonzero(big)
            pairs = self.rules[s[at] - self.first]
            s[at] = pairs[:, 0]
            s = np.insert(s, at + 1, pairs[:, 1])
        return s.astype("<u4")

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64) - self.first
        return np.where(s < 0, 1, self.lengths.astype(np.int64)[np.maximum(s, 0)] if len(self.lengths) else 1)

    def all(self) -> np.ndarray:
        """All ids.  Nonterminals are expanded once each, in the order of their rules, then copied."""
        if not len(self.rules):
            return self.symbols.astype("<u4")
        n = self.lengths.astype(np.int64)
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        flat = self._expand(np.arange(self.first, self.first + len(self.rules)))
        s = self.symbols.astype(np.int64) - self.first
        size = self._length(self.symbols)
        ends = np.cumsum(size)
        out = np.repeat(np.where(s < 0, 0, at[np.maximum(s, 0)]) - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        plain = np.repeat(s < 0, size)
        ids = flat[np.where(plain, 0, out)]
        ids[plain] = self.symbols[s < 0]
        return ids

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids start <= i < stop; only symbols that hold them are expanded."""
        stop = min(stop, self.ids)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        block = int(np.searchsorted(self.marks, start, side="right")) - 1
        last = int(np.searchsorted(self.marks, stop, side="left"))
        symbols = self.symbols[block * STRIDE : last * STRIDE]
        ends = np.cumsum(self._length(symbols)) + int(self.marks[block])
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        at = int(ends[a - 1]) if a else int(self.marks[block])
        return self._expand(symbols[a:b])[start - at : stop - at]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


def pack_shard(doc_ids: list, ids: np.ndarray, starts: np.ndarray, vocabulary: int) -> bytes:
    """The bytes of one shard."""
    narrow = vocabulary < 1 << 16
    symbols, rules = compress(ids, vocabulary, 1 << 16 if narrow else min(1 << 31, 1 << ((63 - max(len(ids), 1).bit_length()) // 2)))
    n = lengths(rules, vocabulary)
    s = symbols.astype(np.int64) - vocabulary
    size = np.where(s < 0, 1, n[np.maximum(s, 0)] if len(n) else 1)
    marks = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)[:-1]))[::STRIDE] if len(size) else np.zeros(0)
    width = 2 if narrow else 4
    parts = (np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), starts.astype("<u8"), rules.astype("<u4"), n.astype("<u4"), marks.astype("<u8"), symbols.astype(f"<u{width}"))
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(rules), len(symbols), vocabulary, width) + b"".join(x.tobytes() for x in parts)


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, part, shard = token_ids(tokenizer, MEMORY), TaskContext.get().partitionId(), 0
    vocabulary = max(encode.library.get_vocab_size(with_added_tokens=True), end_id + 1)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())])
    ids, docs, held = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal shard, ids, docs, held
        starts = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) // 4 for x in ids])))
        blob = pack_shard(docs, np.frombuffer(b"".join(ids), "<u4"), starts, vocabulary)
        out = pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, shard, len(docs), int(starts[-1]), blob), schema)], schema=schema)
        shard, ids, docs, held = shard + 1, [], [], 0
        return out

    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = encode.encode(text) + end
            if held and held + len(x) // 4 > SHARD_IDS:
                yield flush()
            docs.append(doc)
            ids.append(x)
            held += len(x) // 4
    if docs:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    for batch in slices(batches):
        for first, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = Shard(blob.as_buffer())
            ids, at = shard.all(), shard.starts.astype(np.int64)
            for i in range(0, shard.docs, 256):
                j = min(i + 256, shard.docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids[i:j], pa.int64(), mask=shard.null_ids[i:j].astype(bool)),
                    pa.array(at[i:j] + first, pa.int64()),
                    pa.array([ids[at[k] : at[k + 1]].tobytes() for k in range(i, j)], pa.binary()),
                ], schema=schema)


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of ids (nulls first, ties by text).

    One shuffle by range of ids, and of texts' beginnings within an id that many rows have; each task encodes its range in
    order and writes shards of about SHARD_IDS ids as rows (part, shard, n_docs, n_ids, blob) below ``path``/shards, by
    Spark's committed writes.  ``path``/index gets
    the number of ids before each shard.  Null texts are empty: their only id is ``end_id``.  A document longer than
    a shard is a shard of its own.
    """
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    with small_batches(spark):
        dealt.mapInArrow(lambda it: _write(it, tokenizer, end_id), "part int, shard int, n_docs long, n_ids long, blob binary").write.mode("overwrite").parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards").select("part", "shard", "n_ids")
    # Sums by part first: only one row of each part meets in the last window.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    shards.withColumn("inner", inner).join(parts, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("first")).write.mode("overwrite").parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, start, ids): the ids of each document as little-endian 32-bit integers, and the number of all ids
    before it."""
    shards, index = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/index")
    return shards.select("part", "shard", "blob").join(index, ["part", "shard"]).select("first", "blob").mapInArrow(_read, "id long, start long, ids binary")
