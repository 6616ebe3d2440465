"""Removal of lines that repeat or nearly repeat an earlier line: an exact set-similarity join with prefix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .shingles import _SHINGLE, STEP, WORDS, _hash, _long_words, mix, shingle_set, utf8
from .workspace import BROADCAST_IDS, Workspace, keyed, slices

_U = np.uint64
#: Counters of the rarity table: 1 MB, whatever the number of lines.  Tokens that share a counter share its count;
#: any fixed order of tokens gives the same result, so this costs candidates only where frequent tokens meet.
COUNTERS = 1 << 17
#: Groups of one token up to this size give all their pairs; larger ones first pair each member with the LEADERS
#: earliest, and then only members that found no match with the others.
GROUP, LEADERS = 32, 8
#: A bucket gets about so many shingles of the corpus, or fewer; a token whose counter lies more than HOT_TOKEN above the
#: mean is dealt to as many blocks as bring each below that, so what a task holds doesn't grow with the corpus or a token.
BUCKET_SHINGLES, HOT_TOKEN = 1 << 24, 1 << 22
#: Shingles gathered by a task before it hands them on.
CHUNK = 1 << 20


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the non-empty lines of texts, with each line's text and number in it."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[lo:hi] == 10) + lo + 1
    starts = np.unique(np.concatenate([offsets[:-1], breaks]))
    starts = starts[starts < hi]
    # An offset may belong to several texts, all but the last of them empty.
    doc = np.searchsorted(offsets, starts, side="right") - 1
    number = np.searchsorted(breaks, starts, side="right") - np.searchsorted(breaks, offsets[doc], side="right")
    return np.append(starts, hi), doc, number


def line_shingles(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, lines) of the five-word shingles of all lines, in order, not yet distinct."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + STEP, side="right")) - 1))
        lo, hi = int(bounds[i]), int(bounds[j])
        if hi - lo > STEP:  # a single line
            s = shingle_set(_long_words(data[lo:hi]))
            yield s, np.full(len(s), i)
        elif hi > lo:
            at = bounds[i : j + 1] - lo
            words, starts = _hash(data[lo:hi], at[:-1])
            line = np.searchsorted(at, starts, side="right") - 1
            m = len(words) - WORDS + 1
            if m > 0:
                whole = line[:m] == line[WORDS - 1 :]
                out = np.full(m, WORDS, dtype=_U)
                for k in range(WORDS):
                    out = out * _U(_SHINGLE) + words[k : k + m]
                yield mix(out[whole]), line[:m][whole] + i
            first = np.searchsorted(line, np.arange(j - i))
            size = np.searchsorted(line, np.arange(j - i), side="right") - first
            for few in range(1, WORDS):
                short = np.flatnonzero(size == few)
                if len(short):
                    out = np.full(len(short), few, dtype=_U)
                    for k in range(few):
                        out = out * _U(_SHINGLE) + words[first[short] + k]
                    yield mix(out), short + i
        i = j


def _rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in slices(batches):
        data, offsets = utf8(batch.column(1))
        if offsets[-1] > offsets[0]:
            for h, _ in line_shingles(data, line_bounds(data, offsets)[0]):
                counts += np.bincount((h & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    part = COUNTERS // 16
    yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([counts[i * part : (i + 1) * part].tobytes() for i in range(16)], pa.binary())], names=["part", "counts"])


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS // 16, dtype=np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


_TOKEN = np.dtype([("token", "<u8"), ("doc", "<i8"), ("line", "<u4"), ("n", "<u4"), ("at", "<u4"), ("set", "<u8")])
_CLASS = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("line", "<u4")])
_BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


#: Bits of a token that travel.  Tokens only make candidates, so a chance meeting costs a comparison and loses nothing.
TOKEN_BITS = (1 << 48) - 1


def _blob(records: np.ndarray) -> bytes:
    """The number of records, then column after column, the first bytes of all values before the second ones, compressed;
    documents as differences."""
    columns = [np.diff(records[name], prepend=records[name].dtype.type(0)) if name == "doc" else np.ascontiguousarray(records[name]) for name in records.dtype.names]
    raw = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(records).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _records(blobs: list, kind: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        out, at = np.empty(int.from_bytes(blob[:8], "little"), dtype=kind), 0
        raw = pa.decompress(blob[8:], len(out) * kind.itemsize, codec="zstd", asbytes=True)
        for name in kind.names:
            size = kind[name].itemsize
            planes = np.frombuffer(raw, np.uint8, count=len(out) * size, offset=at).reshape(size, len(out))
            column = np.ascontiguousarray(planes.T).view(kind[name]).ravel()
            out[name] = np.cumsum(column) if name == "doc" else column
            at += len(out) * size
        parts.append(out)
    return np.concatenate(parts)


def by_rarity(h: np.ndarray, line: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of tokens by line, then from the rarest counter on, then by hash.  What fits of the three into one number
    is sorted; tokens of a line that it doesn't tell apart are rare, and then all three are."""
    place = rank[(h & _U(COUNTERS - 1)).astype(np.int64)]
    bits = COUNTERS.bit_length() - 1
    left = 64 - bits - int(line.max(initial=0)).bit_length()
    if left >= 16:
        key = ((line.astype(_U) << _U(bits)) | place.astype(_U)) << _U(left) | h >> _U(64 - left)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        if (h[order[1:]] == h[order[:-1]])[same].all():
            return order
    return np.lexsort((h, place, line))


def _deal(batches: Iterator[pa.RecordBatch], rarity: np.ndarray, buckets: int, percent: int, hot: int = HOT_TOKEN) -> Iterator[pa.RecordBatch]:
    """Blobs of prefix tokens (kind 0; 3 for blocks of hot ones) and of classes (1) by bucket, and of lines that an
    earlier line of the same chunk equals (2)."""
    held: list[tuple] = []
    total, mean = 0, int(rarity.mean())
    rank = np.empty(COUNTERS, dtype=np.int64)
    rank[np.argsort(rarity, kind="stable")] = np.arange(COUNTERS)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, total
        h = np.concatenate([x[0] for x in held])
        line = np.concatenate([x[1] for x in held])
        docs, numbers = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        held, total = [], 0
        order = by_rarity(h, line, rank)
        h, line = h[order], line[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h, line = h[new], line[new]
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        n = np.diff(np.append(first, len(h)))
        name = line[first]
        classes = np.zeros(len(first), dtype=_CLASS)
        classes["k1"], classes["k2"] = np.add.reduceat(mix(h ^ _U(0x243F6A8885A308D3)), first), np.add.reduceat(mix(h ^ _U(0x13198A2E03707344)), first)
        classes["doc"], classes["line"] = docs[name], numbers[name]
        order = np.lexsort((classes["line"], classes["doc"], classes["k2"], classes["k1"]))
        s = classes[order]
        earliest = np.ones(len(s), dtype=bool)
        earliest[1:] = (s["k1"][1:] != s["k1"][:-1]) | (s["k2"][1:] != s["k2"][:-1])
        chosen = np.zeros(len(s), dtype=bool)
        chosen[order[earliest]] = True
        length = np.where(chosen, n - -(-percent * n // 100) + 1, 0)
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        tokens = np.zeros(len(at), dtype=_TOKEN)
        whole = h[np.repeat(first, length) + at]
        tokens["token"], tokens["at"] = whole & _U(TOKEN_BITS), at
        for field, column in (("doc", classes["doc"]), ("line", classes["line"]), ("n", n), ("set", classes["k1"])):
            tokens[field] = np.repeat(column, length)
        rows = [(0, 2, _blob(s[~earliest]))] if not earliest.all() else []
        above = np.maximum(rarity[(whole & _U(COUNTERS - 1)).astype(np.int64)] - mean, 1)
        blocks = (-(-above // hot)).astype(_U)
        split = blocks > 1
        block = mix(tokens["doc"].astype(_U) * _U(_SHINGLE) + tokens["line"]) % blocks
        parts = ((0, tokens[~split], whole[~split]), (3, tokens[split], mix(whole + block)[split]), (1, s[earliest], s["k1"][earliest]))
        for kind, records, key in parts:
            bucket = ((key >> _U(33)) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)  # short ones are sorted by digits
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows += [(b, kind, _blob(records[order[cuts[b] : cuts[b + 1]]])) for b in range(buckets) if cuts[b + 1] > cuts[b]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_BLOBS)], schema=_BLOBS)

    base = 0
    for batch in slices(batches):
        data, offsets = utf8(batch.column(1))
        if offsets[-1] == offsets[0]:
            continue
        bounds, doc, number = line_bounds(data, offsets)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        part = list(line_shingles(data, bounds))
        if part:
            held.append((np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part]) + base, ids[doc], number))
            base += len(doc)
            total += len(held[-1][0])
        if total >= CHUNK:
            yield from flush()
            base = 0
    if held:
        yield from flush()


_FOUND = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("d1", pa.int64()), ("l1", pa.int64()), ("n1", pa.int64()), ("p1", pa.int64()), ("d2", pa.int64()), ("l2", pa.int64())])
_FOUND_SQL = "kind int, token long, d1 long, l1 long, n1 long, p1 long, d2 long, l2 long"


def _matches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each bucket: lines that equal an earlier one (kind 2), candidates of a line and an earlier one (0), and
    the members of large groups and of blocks (4)."""

    def blobs() -> Iterator[tuple[tuple[int, int], list]]:
        """The blobs of one bucket and kind after the other; rows come in that order."""
        now, held = None, []
        for batch in batches:
            for *of, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if of != now:
                    if held:
                        yield tuple(now), held
                    now, held = of, []
                held.append(blob)
        if held:
            yield tuple(now), held

    def rows(kind: int, token, d1, l1, n1=None, p1=None, d2=None, l2=None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(d1), 1 << 14):
            cut = slice(i, i + (1 << 14))
            size = len(d1[cut])
            columns = [np.full(size, kind, np.int32)] + [np.zeros(size, np.int64) if c is None else c[cut].astype(np.int64) for c in (token, d1, l1, n1, p1, d2, l2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _FOUND)], schema=_FOUND)

    for (_, kind), parts in blobs():
        if kind == 2:
            s = _records(parts, _CLASS)
            yield from rows(2, None, s["doc"], s["line"])
        elif kind == 1:
            s = _records(parts, _CLASS)
            s = s[np.lexsort((s["line"], s["doc"], s["k2"], s["k1"]))]
            later = (s["k1"][1:] == s["k1"][:-1]) & (s["k2"][1:] == s["k2"][:-1])
            yield from rows(2, None, s["doc"][1:][later], s["line"][1:][later])
        else:
            s = _records(parts, _TOKEN)
            if kind == 0:
                token = np.ascontiguousarray(s["token"])
                order = np.argsort(token)
                token = token[order]
                twice = np.zeros(len(s), dtype=bool)
                twice[1:] = token[1:] == token[:-1]
                twice[:-1] |= twice[1:]
                s = s[order[twice]]
            s = s[np.lexsort((s["line"], s["doc"], s["n"], s["set"], s["token"]))]
            one = np.ones(len(s), dtype=bool)  # the earliest of lines with the same set
            one[1:] = (s["token"][1:] != s["token"][:-1]) | (s["set"][1:] != s["set"][:-1]) | (s["n"][1:] != s["n"][:-1])
            s = s[one]
            s = s[np.lexsort((s["line"], s["doc"], s["token"]))]
            first = np.flatnonzero(np.concatenate(([True], s["token"][1:] != s["token"][:-1]))) if len(s) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(s)))
            rank, start, group = np.arange(len(s)) - np.repeat(first, size), np.repeat(first, size), np.repeat(size, size)
            seen = []
            for k in range(GROUP - 1):  # each line with the k-th of its group
                later = np.flatnonzero((rank > k) & ((group <= GROUP) | (k < LEADERS)))
                if not len(later):
                    break
                a, b = s[later], s[start[later] + k]
                least = -(-percent * (a["n"].astype(np.int64) + b["n"]) // (100 + percent))
                most = 1 + np.minimum(a["n"].astype(np.int64) - a["at"], b["n"].astype(np.int64) - b["at"]) - 1
                good = (100 * np.minimum(a["n"], b["n"]).astype(np.int64) >= percent * np.maximum(a["n"], b["n"]).astype(np.int64)) & (most >= least)
                if good.any():
                    seen.append(np.stack([a["doc"][good], a["line"][good].astype(np.int64), b["doc"][good], b["line"][good].astype(np.int64)], axis=1))
            if seen:
                pairs = np.unique(np.concatenate(seen), axis=0)
                yield from rows(0, None, pairs[:, 0], pairs[:, 1], None, None, pairs[:, 2], pairs[:, 3])
            hot = s[group > GROUP] if kind == 0 else s
            if len(hot):
                yield from rows(4, hot["token"].view(np.int64), hot["doc"], hot["line"], hot["n"], hot["at"])


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the lines named beside each text."""
    schema = pa.schema([("d", pa.int64()), ("l", pa.int64()), ("s", pa.binary())])
    for batch in slices(batches):
        data, offsets = utf8(batch.column(1))
        if offsets[-1] == offsets[0]:
            continue
        bounds, doc, number = line_bounds(data, offsets)
        wanted = batch.column(2)
        size = pc.list_value_length(wanted).to_numpy(zero_copy_only=False)
        asked = np.repeat(np.arange(len(size)), size) << 40 | wanted.flatten().to_numpy(zero_copy_only=False)
        need = np.isin(doc << 40 | number, asked)
        part = list(line_shingles(data, bounds))
        if not part or not need.any():
            continue
        h, line = np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part])
        h, line = h[need[line]], line[need[line]]
        if not len(h):
            continue
        order = np.lexsort((h, line))
        h, line = h[order], line[order]
        cuts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sets = [np.unique(x).tobytes() for x in np.split(h, cuts[1:])]
        names = line[cuts]
        for i in range(0, len(sets), 2048):
            cut = slice(i, i + 2048)
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc[names[cut]]], pa.int64()), pa.array(number[names[cut]], pa.int64()), pa.array(sets[cut], pa.binary())], schema=schema)


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _few(lists: DataFrame, column: str) -> bool:
    """Whether a table of lists is small enough to be broadcast: by all its entries, not by its rows."""
    return lists.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0))).first()[0] <= BROADCAST_IDS


def _verified(ws: Workspace, name: str, texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines (d, l) of those of the pairs that are similar, by their whole sets."""
    pairs = ws.save(pairs, f"{name}-pairs")
    ends = F.explode(F.array(F.struct(F.col("d1").alias("d"), F.col("l1").alias("l")), F.struct(F.col("d2").alias("d"), F.col("l2").alias("l"))))
    needed = ws.save(pairs.select(ends.alias("x")).groupBy(F.col("x.d").alias("pid")).agg(F.collect_set("x.l").alias("lines")), f"{name}-needed")
    asked = texts.join(F.broadcast(needed) if _few(needed, "lines") else needed, F.col("id") == F.col("pid")).select("id", "text", "lines")
    sets = ws.save(asked.mapInArrow(_line_sets, "d long, l long, s binary"), f"{name}-sets")
    a, b = sets.select(F.col("d").alias("d1"), F.col("l").alias("l1"), F.col("s").alias("s1")), sets.select(F.col("d").alias("d2"), F.col("l").alias("l2"), F.col("s").alias("s2"))
    full = pairs.join(a, ["d1", "l1"]).join(b, ["d2", "l2"]).select(F.col("d1").alias("d"), F.col("l1").alias("l"), "s1", "s2")
    return ws.save(full.mapInArrow(lambda it: _similar(it, percent), "d long, l long").distinct(), f"{name}-lines")


def repeated_lines(spark: SparkSession, docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_TOKEN) -> DataFrame:
    """Rows (``id_col``, line): the lines, counted from 0 in their text, that come after a line (by id, then line) whose
    set of five-word shingles is the same or has a Jaccard similarity of ``percent`` of 100 or more with theirs.

    A line's tokens are its shingles, ordered by rarity.  Lines of one set are one class: a task keeps the earliest
    of each, so copies of a common line don't travel.  Classes that are similar share a token among the first
    n - ceil(percent * n / 100) + 1; those are dealt by token, in blocks.  Candidates pass the length and positional
    filters and are verified on whole sets.  In groups of one token beyond GROUP classes, each is held against the
    earliest LEADERS first; those without a match are then held against all earlier ones.  A token that occurs more
    than ``hot`` times is dealt to blocks of lines, each with leaders of its own; what no line of the block removes is
    held against the earlier lines of all blocks, in a join that Spark can split.
    Lines without words are never removed.  Rows with a null id take no part.  Ids must tell rows apart;
    ``dedup_lines`` gives rows keys of their own where they don't.
    """
    ws = Workspace(spark, "line-dedup")
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    counts = texts.mapInArrow(_rarity, "part int, counts binary").groupBy("part").applyInArrow(_added, "part int, counts binary")
    rarity = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in counts.orderBy("part").collect()] or [np.zeros(COUNTERS, np.int64)])
    shared = spark.sparkContext.broadcast(np.minimum(rarity, 2**31 - 1).astype(np.int32))  # COUNTERS numbers
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rarity.sum()) // BUCKET_SHINGLES))
    dealt = texts.mapInArrow(lambda it: _deal(it, shared.value, buckets, percent, hot), "bucket int, kind int, blob binary")
    found = ws.save(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda it: _matches(it, percent), _FOUND_SQL), "found")
    equal = found.where("kind = 2").select(F.col("d1").alias("d"), F.col("l1").alias("l"))
    pairs = found.where("kind = 0").select("d1", "l1", "d2", "l2").distinct()
    near = _verified(ws, "near", texts, pairs, percent)

    members = found.where("kind = 4").select("token", "d1", "l1", "n1", "p1")
    # Lines that are known to go needn't be held against more.
    alone = members.join(near.union(equal), (F.col("d1") == F.col("d")) & (F.col("l1") == F.col("l")), "left_anti")
    other = members.select(F.col("token").alias("same"), F.col("d1").alias("d2"), F.col("l1").alias("l2"), F.col("n1").alias("n2"), F.col("p1").alias("p2"))
    later = (F.col("d1") > F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("l1") > F.col("l2")))
    close = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    reach = (100 + percent) * F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) >= percent * (F.col("n1") + F.col("n2"))
    more = alone.join(other, (F.col("token") == F.col("same")) & later & close & reach).select("d1", "l1", "d2", "l2").distinct()
    rest = _verified(ws, "rest", texts, more.join(pairs, ["d1", "l1", "d2", "l2"], "left_anti"), percent)
    return equal.union(near).union(rest).distinct().select(F.col("d").alias(id_col), F.col("l").alias("line"))


def dedup_lines(spark: SparkSession, docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_lines, n_removed, text (without the lines of ``repeated_lines``).

    Null texts are empty: one line without words.  Rows with a null id keep their text.  Rows that repeat an id are
    judged each by its own text, in an order of hashes of texts; of equal rows, the first keeps its lines.
    """
    ws = Workspace(spark, "line-dedup-texts")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, key = keyed(spark, docs.where("id is not null"), "line-dedup-rows", "id")
    gone = repeated_lines(spark, rows, percent, key)
    gone = ws.save(gone.groupBy(F.col(key).alias("gid")).agg(F.collect_set("line").alias("gone")), "gone")
    rows = rows.select("id", F.col(key).alias("key"), "text").unionByName(docs.where("id is null").select("id", F.lit(None).cast("long").alias("key"), "text"))
    rows = rows.select("id", "key", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    joined = rows.join(F.broadcast(gone) if _few(gone, "gone") else gone, F.col("key") == F.col("gid"), "left")
    # What stands between two removed lines is one slice, so the work is linear in a text's lines.
    bounds = F.concat(F.array(F.lit(-1)), F.transform(F.array_sort("gone"), lambda x: x.cast("int")), F.array(F.size("lines")))
    between = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", bounds[k] + 2, bounds[k + 1] - bounds[k] - 1))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(between))
    x = joined.select("id", "lines", kept.alias("kept"))
    return x.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"),
    )
