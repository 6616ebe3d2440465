"""MinHash near-deduplication with b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .components import connected_components
from .shingles import mix, shingle_set, utf8, words_of
from .workspace import BROADCAST_IDS, Workspace, fair_share, join_groups, slices

HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
_U = np.uint64
_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
#: Candidates whose estimate is below threshold - SLACK are not compared.  0.23 is five standard deviations of the
#: estimate at a similarity of 0.75, so a true pair is lost with a probability below 1e-6.
SLACK = 0.23
#: Rows and shingles of a block of a bucket's outsiders, and of those they are held against: what is compared in one go.
X_ROWS, Y_ROWS, LEAST_ROWS = 1 << 12, 1 << 14, 1 << 8
X_SHINGLES, Y_SHINGLES = 1 << 19, 1 << 21
#: Pairs and shared shingles that a worker counts at a time.
CELLS = 1 << 20
_SIGNED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.LongType())),
])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set that isn't empty."""
    low = np.full(HASHES, _U(2**64 - 1))
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[None, i : i + 2048] * _MULTIPLIERS[:, None]).min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into 64-bit words."""
    bits = mix(low) & _U(2**BITS - 1)
    per = 64 // BITS
    return (bits.reshape(-1, per) << (np.arange(per, dtype=_U) * _U(BITS))).sum(axis=1, dtype=_U)


def bands_of(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS minima; the band's number is mixed in."""
    key = np.arange(BANDS, dtype=_U)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key * _U(0xD6E8FEB86659FD93) + column)
    return key


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])
    for batch in slices(batches):
        n, keys, bands, sigs = [], [], [], []
        for words in words_of(*utf8(batch.column(1))):
            s = shingle_set(words)
            n.append(len(s))
            if len(s):
                low = minima(s)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(bands_of(low).view(np.int64))
                sigs.append(pack(low).view(np.int64))
            else:
                keys.append(None)
                bands.append(None)
                sigs.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("s", pa.binary())])
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(w).tobytes() for w in words_of(*utf8(batch.column(1)))], pa.binary())], schema=schema)


def _small_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("s", pa.binary())])
    for batch in slices(batches):
        sets = [np.unique(shingle_set(w).astype(np.uint32)).tobytes() for w in words_of(*utf8(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=schema)


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], x_block: np.ndarray, y_block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers in x, numbers in y, shared shingles) of all pairs of sets of one block that share any.  Blocks ascend on
    both sides.  Shingles of all blocks are looked up at once, as numbers with their block in the upper half."""
    i = 0
    first, last = np.searchsorted(y_block, x_block, side="left"), np.searchsorted(y_block, x_block, side="right")
    while i < len(x):
        # Sets of x whose pairs are counted together: of several blocks, or some of one.
        cells = np.cumsum(last[i:] - first[i:])
        j = i + max(1, int(np.searchsorted(cells, CELLS, side="right")))
        offset = np.concatenate((np.zeros(1, np.int64), cells[: j - i]))
        a, b = int(first[i]), int(last[j - 1])
        if b > a:
            own = np.concatenate([x[k].astype(_U) | _U(int(x_block[k]) << 32) for k in range(i, j)])
            who = np.repeat(np.arange(j - i), [len(x[k]) for k in range(i, j)])
            order = np.argsort(own, kind="stable")
            own, who = own[order], who[order]
            counts = np.zeros(int(offset[-1]), dtype=np.int32)
            k = a
            while k < b:
                size = np.cumsum([len(s) for s in y[k : min(b, k + Y_ROWS)]])
                stop = k + max(1, int(np.searchsorted(size, CELLS // 4, side="right")))
                theirs = np.concatenate([y[n].astype(_U) | _U(int(y_block[n]) << 32) for n in range(k, stop)])
                place = np.repeat(np.arange(k, stop), [len(y[n]) for n in range(k, stop)])
                low, high = np.searchsorted(own, theirs, side="left"), np.searchsorted(own, theirs, side="right")
                met = np.flatnonzero(high > low)
                low, times, place = low[met], (high - low)[met], place[met]
                ends = np.cumsum(times)
                at = 0
                while at < len(times):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
                    t = times[at:to]
                    within = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
                    mine = who[np.repeat(low[at:to], t) + within]
                    cell = offset[mine] + np.repeat(place[at:to], t) - first[i + mine]
                    counts += np.bincount(cell, minlength=len(counts)).astype(np.int32)
                    at = to
                k = stop
            found = np.flatnonzero(counts)
            mine = np.searchsorted(offset, found, side="right") - 1
            yield i + mine, found - offset[mine] + first[i + mine], counts[found]
        i = j


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) inside blocks; rows of a block follow one another."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[pa.RecordBatch] = []
    size = 0

    def links(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table.column(c).to_numpy() for c in ("bucket", "xb", "yb", "id", "root", "main", "as_x", "as_y")}
        sets = [np.frombuffer(v.as_buffer(), np.uint32) for v in table.column("s")]
        key = np.stack([cols["bucket"], cols["xb"], cols["yb"]])
        block = np.cumsum(np.concatenate(([0], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        x, y = np.flatnonzero(cols["as_x"]), np.flatnonzero(cols["as_y"])
        out = []
        for p, q, both in shared_counts([sets[k] for k in x], [sets[k] for k in y], block[x], block[y]):
            p, q = x[p], y[q]
            n = np.array([len(v) for v in sets])
            # Sets of 32-bit hashes may differ from the full ones by a collision.
            good = 100 * both.astype(np.int64) >= (percent - 1) * (n[p] + n[q] - both)
            good &= (cols["root"][p] != cols["root"][q]) & ((cols["root"][q] == cols["main"][q]) | (cols["id"][p] > cols["id"][q]))
            out.append(np.stack([np.maximum(cols["id"][p], cols["id"][q]), np.minimum(cols["id"][p], cols["id"][q])])[:, good])
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < 4 * Y_SHINGLES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(c)[-1].as_py() for c in ("bucket", "xb", "yb")]
        key = np.stack([table.column(c).to_numpy() for c in ("bucket", "xb", "yb")])
        cut = int(np.argmax((key == np.array(last)[:, None]).all(axis=0)))  # the last block may go on
        if cut:
            yield links(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held and sum(b.num_rows for b in held):
        yield links(pa.Table.from_batches(held).combine_chunks())


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            small, large = (p, q) if len(p) <= len(q) else (q, p)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def similarity(a: str, b: str) -> Column:
    """Jaccard similarity of two packed signatures, estimated from the mismatched pairs of bits: two unequal minima agree in their bits by chance with
    probability 2**-BITS, which is taken out."""
    low = 0x5555555555555555
    wrong = sum((F.bit_count(F.expr(f"(({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & {low}L")) for i in range(HASHES * BITS // 64)), F.lit(0))
    chance = 2.0**-BITS
    return ((1 - wrong / HASHES) - chance) / (1 - chance)


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """The pairs with the set of one of their ends.  An end of very many pairs, as the centre of a large group is, has
    its set copied to several tasks, which share its pairs."""
    fair = fair_share(pairs.sparkSession, pairs.count())
    hot = pairs.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > fair).select(end, F.ceil(F.col("n") / max(fair, 1)).alias("parts"))
    sets = sets.select(F.col("id").alias(end), F.col("s").alias(name))
    if hot.isEmpty():
        return pairs.join(sets, end)
    hot = F.broadcast(hot)  # each has its share of the pairs, so there are few
    part = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1).cast("long")))
    left = pairs.join(hot, end, "left").withColumn("part", part).drop("parts")
    right = sets.join(hot, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    return left.join(right, [end, "part"]).drop("part")


def _confirmed(ws: Workspace, name: str, docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets reach the similarity.  Only texts that take part are read
    again; their ids are broadcast if counted to be few."""
    pairs = ws.save(pairs, f"{name}-pairs")
    ids = ws.save(pairs.select(F.explode(F.array("a", "b")).alias("pid")).distinct(), f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("pid"), "left_semi")
    sets = ws.save(texts.mapInArrow(_sets, "id long, s binary"), f"{name}-sets")
    both = _with_sets(_with_sets(pairs, sets, "a", "s1"), sets, "b", "s2").select("a", "b", "s1", "s2")
    out = ws.save(both.mapInArrow(lambda it: _verify(it, percent), "a long, b long"), f"{name}-links")
    ws.drop(f"{name}-pairs", f"{name}-ids", f"{name}-sets")
    return out


def _across(ws: Workspace, docs: DataFrame, members: DataFrame, roots: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between different components inside buckets; None if every bucket holds one component.

    A bucket's members outside its main component are held against all its members of other components.  Both sides are
    dealt to blocks of bounded size, each pair of blocks meets in one place, and only links come out: neither a bucket
    nor its pairs are ever together.
    """
    now = members.join(roots, "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    parts = now.groupBy("bucket", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    mixed = parts.groupBy("bucket").agg(
        F.count("*").alias("roots"), F.max(F.struct("rows", "root", "shingles")).alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")
    )
    mixed = ws.save(mixed.where("roots > 1"), "mixed")
    if not (total := mixed.agg(F.sum("rows")).first()[0]):
        return None
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    fair = max(LEAST_ROWS, total // n)  # so that no block has more rows than a task gets anyway
    blocks = lambda rows, shingles, r, s: F.ceil(F.greatest(rows / min(r, fair), shingles / s)).alias
    out, all_ = (F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")), (F.col("rows"), F.col("shingles"))
    mixed = mixed.select("bucket", F.col("main.root").alias("main"), blocks(*out, X_ROWS, X_SHINGLES)("kx"), blocks(*all_, Y_ROWS, Y_SHINGLES)("ky"))
    open_ = ws.save(now.join(mixed, "bucket"), "open")
    ids = ws.save(open_.select(F.col("id").alias("pid")).distinct(), "open-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("pid"), "left_semi")
    sets = ws.save(texts.mapInArrow(_small_sets, "id long, s binary").distinct(), "open-sets")  # an id may have several texts

    # Each row stands in one block of either side; there it meets every block of the other.
    outside = F.col("root") != F.col("main")
    xb, yb = F.pmod(F.xxhash64("id", F.lit(1)), F.col("kx")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("ky"))
    zero = F.lit(0).cast("long")
    cell = lambda i, j, x, y: F.struct(i.alias("xb"), j.alias("yb"), x.alias("as_x"), y.alias("as_y"))
    held = F.transform(F.sequence(zero, F.col("kx") - 1), lambda i: cell(i, yb, outside & (i == xb), F.lit(True)))
    more = F.transform(F.filter(F.sequence(zero, F.col("ky") - 1), lambda j: outside & (j != yb)), lambda j: cell(xb, j, F.lit(True), F.lit(False)))
    rows = open_.join(sets, "id").select("bucket", "id", "root", "main", "s", F.explode(F.concat(held, more)).alias("c")).select("bucket", "c.*", "id", "root", "main", "s")
    keys = ["bucket", "xb", "yb"]
    links = rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _compare(it, percent), "a long, b long")
    return _confirmed(ws, "cross", docs, links.distinct(), percent)


def _same_ids(ws: Workspace, rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between an id of several texts and the classes of those texts; None if every id has one text."""
    several = ws.save(rows.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("id").alias("pid")), "repeats")
    if several.isEmpty():
        return None
    few = several.count() <= BROADCAST_IDS
    own = rows.join(F.broadcast(several) if few else several, F.col("id") == F.col("pid"), "left_semi").select("id", "set_key", "n").distinct()
    named = own.join(classes.select("set_key", "n", "rep"), ["set_key", "n"]).where("id <> rep")
    return ws.save(named.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "repeat-links")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of five-word shingles;
    component_id is the smallest id reachable over links.

    * Documents with equal sets are one class from the start; copies never meet in pairs.
    * Classes get 128 minima: 32 bands of 4 make candidates (a pair at 0.75 is missed with probability 5e-6), the
      low 2 bits of each make a 32-byte signature.
    * In each bucket every class is first paired with the smallest id only.  Candidates that the corrected bit count
      doesn't exclude are compared by their full sets, then joined to components.  Buckets which hold a single
      component are done, however large; in the others, members outside of the bucket's main component are held
      against all members of other components, block by block, inside the join.  So no bucket emits its pairs or
      meets in one task, and no link between different components that share a bucket is lost.

    Null or empty texts have an empty set and are linked with nothing.  Rows with a null id come out with a null
    component_id, kept.  Rows that repeat an id count as further texts of that document, so all its rows with words are of
    one component.  Other columns are not read.
    """
    ws = Workspace(spark, "near-dedup")
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = ws.save(docs.mapInArrow(_sign, _SIGNED), "signed")
    some = signed.where("set_key is not null and id is not null")
    # Of a class, any signature will do: they are the same.
    classes = some.groupBy("set_key", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = ws.save(classes, "classes")

    banded = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"), "n")
    heads = banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = ws.save(banded.join(heads, "bucket"), "members")
    signatures = classes.select(F.col("rep").alias("id"), "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        p = pairs.join(signatures.select(F.col("id").alias("a"), F.col("sig").alias("s1")), "a").join(signatures.select(F.col("id").alias("b"), F.col("sig").alias("s2")), "b")
        return p.where(similarity("s1", "s2") >= percent / 100 - SLACK).select("a", "b")

    stars = members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    links = _confirmed(ws, "star", docs, likely(stars), percent)
    if (same := _same_ids(ws, some, classes)) is not None:
        links = links.union(same)
    roots = ws.save(connected_components(ws, links, "star-cc"), "star-roots")
    if (more := _across(ws, docs, members, roots, percent)) is not None:
        roots = ws.save(connected_components(ws, links.union(more), "all-cc"), "roots")

    of_class = classes.join(roots, F.col("rep") == F.col("id"), "left").select("set_key", "n", F.coalesce("root", "rep").alias("root"), "copies")
    of_class = ws.save(of_class, "class-roots")
    # Texts without a set meet no class; the classes of very many copies are joined by broadcast.
    rows = signed.select("id", "n", "set_key")
    known = join_groups(rows.where("set_key is not null"), of_class, ["set_key", "n"], "copies", "left").select("id", "n", "root")
    known = known.unionByName(rows.where("set_key is null").select("id", "n", F.lit(None).cast("long").alias("root")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return known.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )
