"""Lexical and vector search, fusion, re-ranking and gates over sets of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Retrieval
from ..functions import text as T
from ..shipping import ship
from ..storage import Workspace
from . import postings as P


@dataclass(frozen=True)
class Index:
    """``postings`` (id, term, tf, dl), ``terms`` (term, df, idf), ``corpus`` (n, avgdl, avg_idf), and, of an index that was
    written, ``blocks`` of postings by document.  A posting carries its document's length, so a search joins nothing but
    its terms; with blocks, no match is shuffled."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    blocks: DataFrame | None = None


def postings(docs: DataFrame, key: str, text: str, exact: bool = False) -> DataFrame:
    tokens = docs.select(F.col(key).alias("id"), T.tokenize(text, exact).alias("tokens"))
    one = tokens.select("id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return one.groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def build_index(docs: DataFrame, key: str, text: str, epsilon: float = 0.25, stored: DataFrame | None = None) -> Index:
    """The index of a corpus; ``stored`` is a table of its postings, if they were written before.

    A negative idf becomes epsilon times the average over all terms, negative ones included.  The corpus row is joined
    by broadcast: it is one row.
    """
    p = postings(docs, key, text) if stored is None else stored
    df = p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tokens"))
    return index_of(p, df, docs.agg(F.count("*").alias("n")), epsilon)


def index_of(p: DataFrame, df: DataFrame, n: DataFrame, epsilon: float = 0.25) -> Index:
    """The index of postings, frequencies (term, df, tokens) and one row (n), the number of documents."""
    raw = df.join(F.broadcast(n)).withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    sums = raw.agg(F.sum("tokens").alias("tokens"), F.avg("idf0").alias("avg_idf"))
    corpus = n.join(F.broadcast(sums)).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"), "avg_idf")
    idf = F.when(F.col("idf0") < 0, epsilon * F.col("avg_idf")).otherwise(F.col("idf0"))
    return Index(p, raw.join(F.broadcast(corpus.select("avg_idf"))).select("term", "df", idf.alias("idf")), corpus)


def write_index(docs: DataFrame, key: str, text: str, ws: Workspace, exact: bool = False) -> Index:
    """The same as tables in a workspace: what many searches share is made once, by document, without a shuffle of postings."""
    held = ws.save(P.blocks(docs, key, text, exact), "blocks", **P.STORED)
    n = docs.agg(F.count("*").alias("n"))
    index = index_of(P.rows_of(held), ws.save(P.frequencies(held), "frequencies"), n)
    return Index(index.postings, ws.save(index.terms, "terms"), ws.save(index.corpus, "corpus"), held)


#: Terms of queries up to this many are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term, qtf): repetitions count."""
    return queries.select(F.col(key).alias("query"), F.explode(T.tokenize(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def top(df: DataFrame, score: str, k: int, by: str = "query", then: str = "id") -> DataFrame:
    """The k best of each query, ranks from 1; equal scores by id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(then)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(index: Index, terms: DataFrame, k: int = 60, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(query, id, score, rank).  A document is a candidate if it shares a term, whatever the sign of its score; scores
    are rounded before they are ranked, so that the order of summation can't turn near ties.  With blocks, each task keeps
    its k best of each query; else postings that no query asks for drop out where they are read, and the sums of the
    rest are one shuffle."""
    if index.blocks is not None:
        weighted = terms.join(index.terms, "term").select("query", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        avgdl = index.corpus.first()["avgdl"]
        hits = P.search(index.blocks, weighted, k, k1, b, avgdl or 1.0)
        return top(hits.select("query", "id", F.round("score", digits).alias("score")), "score", k)
    asked = terms.join(index.terms, "term").join(F.broadcast(index.corpus.select("avgdl")))
    if terms.count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    matched = index.postings.join(asked, "term").select("query", "id", part.alias("part"))
    return top(matched.groupBy("query", "id").agg(F.round(F.sum("part"), digits).alias("score")), "score", k)


def coverage(index: Index, terms: DataFrame, base: float = 1.0) -> DataFrame:
    """(query, weight): the sparse weight times the share of query terms that the corpus has."""
    known = terms.join(index.terms.select("term", F.lit(1).alias("known")), "term", "left")
    return known.groupBy("query").agg((base * F.sum(F.col("qtf") * F.coalesce("known", F.lit(0))) / F.sum("qtf")).alias("weight"))


#: Queries that one pass over the vectors answers.
QUERY_BLOCK = 4096


#: Scores of queries and documents that are there at once.
CELLS = 1 << 20


class _Top:
    """The k best ids of each query that a task has seen, by score and then by id: scores come rounded, so ties are exact."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k, self.rows = queries, k, max(1, CELLS // max(len(queries), 1))
        self.least = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.kept = 0

    def add(self, score: np.ndarray, names: np.ndarray, least: float | None = None, digits: int | None = None) -> None:
        """A matrix of scores: a row for each query, a column for each id.  With ``digits`` they aren't rounded yet: where few can
        reach the best so far, only these are."""
        if digits is not None:
            near = score >= self.least[:, None] - 10.0**-digits
            if np.count_nonzero(near) <= len(self.queries) * self.k:
                q, d = np.nonzero(near)
                s = np.round(score[q, d], digits) + 0.0
                good = s >= self.least[q] if least is None else (s >= self.least[q]) & (s > least)
                return self._hold(q[good], names[d[good]], s[good])
            score = np.round(score, digits) + 0.0
        border = self.least[:, None]
        if len(names) > self.k:
            border = np.maximum(border, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1, None])
        q, d = np.nonzero(score >= border if least is None else (score >= border) & (score > least))
        self._hold(q, names[d], score[q, d])

    def _hold(self, q: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        self.held.append((q, names, score))
        self.size += len(q)
        if self.size > self.kept + max(CELLS, len(self.queries) * self.k):
            self._keep()

    def _keep(self) -> None:
        if not self.held:
            return
        q, names, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((names, -score, q))
        q, names, score = q[order], names[order], score[order]
        n = np.bincount(q, minlength=len(self.queries))
        place = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        last = place == self.k - 1
        self.least[q[last]] = score[last]
        few = place < self.k
        self.held = [(q[few], names[few], score[few])]
        self.size = self.kept = int(few.sum())

    def hits(self) -> Iterator[pa.RecordBatch]:
        self._keep()
        for q, names, score in self.held:
            for a in range(0, len(q), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(self.queries[q[cut]]), pa.array(names[cut]), pa.array(score[cut])], names=["query", "id", "score"])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    norm[norm == 0] = 1
    return x / norm[:, None]


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    best = _Top(ids, k)
    for whole in batches:
        for i in range(0, whole.num_rows, best.rows):
            batch = whole.slice(i, best.rows)
            vectors = batch.column(1)
            x = _unit(np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1))
            best.add(matrix @ x.T, batch.column(0).to_numpy(zero_copy_only=False), digits=digits)
    yield from best.hits()


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    block: list = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


_HITS = "query long, id long, score double"


def _by_block(corpus: DataFrame, queries: DataFrame, matrix: Callable[[list], np.ndarray], run, k: int) -> DataFrame:
    """The hits of queries in blocks, each answered by one pass over the corpus.  The result of a block is written before
    the next one comes to the driver, so one block is there at a time."""
    spark = corpus.sparkSession
    ship(spark)
    ws, n = None, 0
    last = None
    for block in _blocks(queries.toLocalIterator(), QUERY_BLOCK):
        if last is not None:
            ws = ws or Workspace(spark, "nearest")
            last.write.parquet(f"{ws.path}/hits/block={n}")
            n += 1
        ids, m = np.array([r[0] for r in block], dtype=np.int64), matrix(block)
        last = corpus.mapInArrow(lambda it, ids=ids, m=m: run(it, ids, m), _HITS)
    if last is None:
        return spark.createDataFrame([], _HITS)
    if ws is None:
        return last
    last.write.parquet(f"{ws.path}/hits/block={n}")
    return spark.read.schema(_HITS).parquet(f"{ws.path}/hits").select("query", "id", "score")


def check_vectors(vectors: DataFrame, key: str, column: str, dimension: int) -> DataFrame:
    """(key, problem) of vectors that can't be searched: of another length, without direction, or with values that are no
    finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
    zero = F.forall(column, lambda x: x == 0)
    problem = F.when(F.col(column).isNull() | (F.size(column) != dimension), "dimension").when(bad, "not_finite").when(zero, "zero_norm")
    return vectors.select(key, problem.alias("problem")).where("problem is not null")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 60, key: str = "vec_id", column: str = "embedding", digits: int = 6, itself: bool = True) -> DataFrame:
    """(query, id, score, rank): the k vectors of largest cosine for each query, by exact comparison.

    Queries go to the vectors in blocks of QUERY_BLOCK; a task multiplies CELLS scores at a time and keeps its best k
    (one more where a query may find itself), so what is shuffled is k rows for each task and query.  Vectors
    must have one length (see ``check_vectors``); null and empty ones are left out.
    """
    rows = lambda df: df.where(F.size(column) > 0).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    most = k + (not itself)
    found = _by_block(rows(vectors), rows(queries), lambda b: _unit(np.asarray([r[1] for r in b], dtype=np.float64)), lambda it, ids, m: _nearest(it, ids, m, most, digits), k)
    return top(found if itself else found.where("query <> id"), "score", k)


def hashed_vectors(docs: DataFrame, key: str, text: str, dimension: int = 384, stored: DataFrame | None = None, how: str = "blake2b", blocks: DataFrame | None = None) -> DataFrame:
    """Sparse vectors (id, slots, counts): each term counts in the slot of its hash (BLAKE2b, or SHA-1 in the JVM).  Of ``blocks``
    of postings, which hold documents whole, they are made where those are read, without a shuffle."""
    if dimension < 32:
        raise ValueError("dimension must be at least 32")
    if how not in ("blake2b", "sha1"):
        raise ValueError("how is 'blake2b' or 'sha1'")
    if blocks is not None:
        return P.slots_of(blocks, how, dimension)
    slot = T.blake2b_slot("term", dimension) if how == "blake2b" else F.pmod(F.conv(F.substring(F.sha1("term"), 1, 12), 16, 10).cast("long"), F.lit(dimension))
    p = postings(docs, key, text) if stored is None else stored
    if how == "blake2b":  # each term is hashed once
        p = p.join(p.select("term").distinct().withColumn("slot", slot), "term")
        slot = F.col("slot")
    one = p.select("id", F.struct(slot.cast("int").alias("s"), F.col("tf").alias("c")).alias("x"))
    g = one.groupBy("id").agg(F.collect_list("x").alias("x"))
    return g.select("id", F.transform("x", lambda x: x["s"]).alias("slots"), F.transform("x", lambda x: x["c"]).alias("counts"))


def _dense(slots, counts, n: int, dimension: int) -> np.ndarray:
    sizes = np.asarray([len(s) for s in slots])
    row = np.repeat(np.arange(n), sizes)
    column = np.concatenate([np.asarray(s, dtype=np.int64) for s in slots]) if n else np.zeros(0, np.int64)
    weight = np.concatenate([np.asarray(c, dtype=np.float64) for c in counts]) if n else np.zeros(0)
    return np.bincount(row * dimension + column, weights=weight, minlength=n * dimension).reshape(n, dimension)


def _nearest_hashed(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    dimension, best = matrix.shape[1], _Top(ids, k)
    rows = min(2048, best.rows)
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            batch = whole.slice(i, rows)
            x = _unit(_dense([s.values.to_numpy() for s in batch.column(1)], [c.values.to_numpy() for c in batch.column(2)], batch.num_rows, dimension))
            score = np.round(matrix @ x.T, digits) + 0.0
            best.add(score, batch.column(0).to_numpy(zero_copy_only=False), 0.0)
    yield from best.hits()


def hashed_search(index: DataFrame, queries: DataFrame, k: int = 60, digits: int = 6, dimension: int = 384) -> DataFrame:
    """(query, id, score, rank) by the cosine of ``hashed_vectors``; only documents that share a slot.  A batch of documents is
    filled into a matrix and multiplied with a block of queries."""
    found = _by_block(index, queries, lambda b: _unit(_dense([r[1] for r in b], [r[2] for r in b], len(b), dimension)), lambda it, ids, m: _nearest_hashed(it, ids, m, k, digits), k)
    return top(found, "score", k)


def fuse(rankings: dict[str, tuple[DataFrame, float | Column | DataFrame]], k: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion: (query, id, rrf, sources), where a ranking adds weight / (k + rank).

    A weight is a number or a table (query, weight).  Rankings are stacked and summed, which needs one shuffle instead
    of an outer join for each; a ranking of weight 0 adds no candidates.  Weights must be finite and not negative, and
    a ranking must have an id once for each query: a number is checked here, rows where they are read.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    parts = []
    for name, (ranking, weight) in sorted(rankings.items()):
        if isinstance(weight, DataFrame):
            w = F.col("weight")
            good = F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), F.raise_error(F.lit(f"{name}: a weight is no finite number from 0 on"))).otherwise(w)
            ranking = ranking.join(weight.withColumn("weight", good), "query")
        elif not 0 <= weight < float("inf"):
            raise ValueError("weights must be finite and not negative")
        else:
            ranking = ranking.withColumn("weight", F.lit(float(weight)))
        parts.append(ranking.where("weight > 0").select("query", "id", (F.col("weight") / (k + F.col("rank"))).alias("part"), F.lit(name).alias("source")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    # The shuffle is asked for: rankings that are dealt alike would be summed as they are, yet adaptive execution may have
    # joined the parts of one and not of another.
    g = stacked.repartition("query", "id").groupBy("query", "id").agg(F.sum("part").alias("rrf"), F.array_sort(F.collect_list("source")).alias("sources"))
    once = F.when(F.size(F.array_distinct("sources")) < F.size("sources"), F.raise_error(F.lit("a ranking has an id twice"))).otherwise(F.col("sources"))
    return g.select("query", "id", F.round("rrf", digits).alias("rrf"), once.alias("sources"))


def lexical_rerank(candidates: DataFrame, terms: DataFrame, index: Index, digits: int = 6) -> DataFrame:
    """Adds rerank: the share of a query's distinct terms that a candidate holds.  With blocks, candidates are written first, and
    only their postings are joined."""
    need = terms.groupBy("query").agg(F.count("*").alias("need"))
    if index.blocks is not None:
        candidates = Workspace(candidates.sparkSession, "candidates").save(candidates, "candidates")
    postings = index.postings if index.blocks is None else P.rows_among(index.blocks, candidates)
    wanted = candidates.select("query", "id").join(terms.select("query", "term"), "query")
    held = wanted.join(postings.select("id", "term"), ["id", "term"]).groupBy("query", "id").agg(F.count("*").alias("held"))
    out = candidates.join(held, ["query", "id"], "left").join(need, "query", "left")
    return out.withColumn("rerank", F.round(F.coalesce(F.col("held"), F.lit(0)) / F.greatest(F.coalesce("need", F.lit(0)), F.lit(1)), digits)).drop("held", "need")


#: A reranker: (question, text) as Columns to a score in [0, 1], an expression or an Arrow UDF.
Reranker = Callable[[Column, Column], Column]
#: An encoder: a text as a Column to its vector, an expression or an Arrow UDF.
Encoder = Callable[[Column], Column]


def checked_score(score: Column) -> Column:
    """A reranker's score, or an error if it is none: null, not a number, or outside [0, 1]."""
    bad = score.isNull() | F.isnan(score) | (score < 0) | (score > 1)
    return F.when(bad, F.raise_error(F.lit("a reranker must give scores in [0, 1]"))).otherwise(score)


def checked_vector(vector: Column, dimension: int) -> Column:
    """An encoder's vector, or an error if it has another length or values that aren't finite."""
    bad = vector.isNull() | (F.size(vector) != dimension) | F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"an encoder must give {dimension} finite numbers"))).otherwise(vector)


def model_rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, key: str, query_key: str, text: str, score: Reranker, digits: int = 6) -> DataFrame:
    """Adds rerank by a caller's reranker, which sees each pair once."""
    x = candidates.join(docs.select(F.col(key).alias("id"), F.col(text).alias("__d")), "id").join(queries.select(F.col(query_key).alias("query"), F.col(text).alias("__q")), "query")
    return x.withColumn("rerank", F.round(checked_score(score(F.col("__q"), F.col("__d"))), digits)).drop("__d", "__q")


def long_rerank(pairs: DataFrame, text: str, score: Callable[[Column], Column], most: int = 512, stride: int = 64) -> DataFrame:
    """Adds rerank and windows: texts of more tokens than ``most`` are scored in windows that overlap by ``stride``, and the
    best window counts."""
    if not 0 <= stride < most:
        raise ValueError("0 <= stride < most must hold")
    tokens = F.regexp_extract_all(text, F.lit(T.TOKEN), F.lit(0))
    step = most - stride
    n = F.greatest(F.ceil((F.size("__t") - stride) / step).cast("int"), F.lit(1))
    x = pairs.withColumn("__id", F.monotonically_increasing_id()).withColumn("__t", tokens).withColumn("windows", n)
    w = x.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("windows") - 1))).withColumn("__w", F.array_join(F.slice("__t", F.col("__k") * step + 1, most), " "))
    best = w.withColumn("__s", checked_score(score(F.when(F.col("windows") == 1, F.col(text)).otherwise(F.col("__w")))))
    kept = [c for c in pairs.columns] + ["windows"]
    return best.groupBy("__id").agg(*(F.first(c).alias(c) for c in kept), F.max("__s").alias("rerank")).drop("__id")


def gate(hits: DataFrame, config: Retrieval, substantive: str | None = None) -> DataFrame:
    """Adds eligible: in scope "chunk" a hit that passes the threshold itself, in scope "top" all of a query of which one
    passes; headings (``substantive`` false) never."""
    real = F.col(substantive) if substantive else F.lit(True)
    passes = (F.col("rerank") >= config.rerank_threshold) & real
    if config.gate_scope == "top":
        return hits.withColumn("eligible", F.max(passes).over(Window.partitionBy("query")) & real)
    return hits.withColumn("eligible", passes)


def mix(hits: DataFrame, config: Retrieval, sparse_weight: Column | None = None, digits: int = 6) -> DataFrame:
    """Adds final: alpha of the fused score, as a share of the largest possible one, and 1 - alpha of the reranker's."""
    most = (F.lit(config.dense_weight) + (F.lit(config.sparse_weight) if sparse_weight is None else sparse_weight)) / (config.rrf_k + 1)
    return hits.withColumn("final", F.round(config.rerank_alpha * F.col("rrf") / most + (1 - config.rerank_alpha) * F.col("rerank"), digits))


def hybrid(
    docs: DataFrame, queries: DataFrame, key: str, query_key: str, text: str, config: Retrieval, index: Index | None = None,
    encoder: Encoder | None = None, reranker: Reranker | None = None, dimension: int = 384, how: str = "blake2b", complete: DataFrame | None = None,
) -> DataFrame:
    """The whole search: (query, id, rrf, sources, rerank, weight, final, eligible, rank) of all reranked candidates; rank
    is that of eligible ones, null for the others.

    Without an ``encoder`` and a ``reranker`` of the caller's, hashed vectors and shared terms stand in for them.
    ``complete`` (ids) restricts the search to documents that are stored whole.
    """
    if complete is not None:
        docs = docs.join(complete.select(F.col(complete.columns[0]).alias(key)).distinct(), key, "left_semi")
        index = None
    index = index or write_index(docs, key, text, Workspace(docs.sparkSession, "index"))
    terms = query_terms(queries, query_key, text)
    sparse = bm25(index, terms, config.sparse_candidates)
    weight = coverage(index, terms, config.sparse_weight)
    if encoder is None:
        asked = hashed_vectors(queries, query_key, text, dimension, how=how)
        dense = hashed_search(hashed_vectors(docs, key, text, dimension, index.postings, how, index.blocks), asked, config.dense_candidates, dimension=dimension)
    else:
        v = lambda df, k: df.select(F.col(k).alias("id"), checked_vector(encoder(F.col(text)), dimension).alias("v"))
        dense = nearest(v(docs, key), v(queries, query_key), config.dense_candidates, "id", "v")
    fused = top(fuse({"dense": (dense, config.dense_weight), "sparse": (sparse, weight)}, config.rrf_k), "rrf", config.rerank_candidates).drop("rank")
    scored = lexical_rerank(fused, terms, index) if reranker is None else model_rerank(fused, docs, queries, key, query_key, text, reranker)
    ranked = mix(gate(scored.join(weight, "query"), config), config, F.col("weight"))
    order = Window.partitionBy("query", "eligible").orderBy(F.desc("final"), F.desc("rrf"), F.asc("id"))
    return ranked.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order)))


#: Characters of quotes that are searched for in one pass.
QUOTE_BLOCK = 16 << 20


#: The automaton that a worker made last, by the block it is of.
_MADE: dict[str, tuple] = {}


def _automaton(name: str, quotes: list[tuple[object, str]]) -> tuple:
    """The automaton of a block of quotes and the names of each text; a worker makes it once for all its tasks."""
    if name not in _MADE:
        import ahocorasick

        search, names = ahocorasick.Automaton(), {}
        for quote, text in quotes:
            names.setdefault(text, []).append(quote)
        for text in names:
            search.add_word(text, text)
        search.make_automaton()
        _MADE.clear()
        _MADE[name] = search, names
    return _MADE[name]


def _find(batches: Iterator[pa.RecordBatch], name: str, sent: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        search, names = _automaton(name, sent.value)
        hits = [(quote, key) for key, text in zip(batch.column(0), batch.column(1)) for q in {q for _, q in search.iter(text.as_py())} for quote in names[q]]
        yield pa.RecordBatch.from_arrays([pa.array([str(h[0]) for h in hits], pa.string()), pa.array([h[1].as_py() for h in hits], batch.column(0).type)], names=["quote", "id"])


def containing(docs: DataFrame, quotes: DataFrame, key: str, quote_key: str, text: str) -> DataFrame:
    """(quote, id): documents that hold a quote, both normalised.

    Quotes come in blocks of bounded size, each sent to the workers once and made into one automaton that reads every text
    once, whatever the number and the length of the quotes; texts stay where they are read.
    """
    spark = docs.sparkSession
    ship(spark)
    kinds = dict(quotes.dtypes)[quote_key], dict(docs.dtypes)[key]
    d = docs.select(F.col(key).alias("id"), F.coalesce(T.normalize(text), F.lit("")).alias("t"))
    schema = f"quote string, id {kinds[1]}"
    ws, found, block, size = None, 0, [], 0

    def run(block: list) -> DataFrame:
        sent, made = spark.sparkContext.broadcast(block), uuid.uuid4().hex  # QUOTE_BLOCK characters, or one quote
        return d.mapInArrow(lambda it: _find(it, made, sent), schema)

    last = None
    for name, q in quotes.select(F.col(quote_key).alias("quote"), T.normalize(text).alias("words")).where("words <> ''").toLocalIterator():
        if block and size + len(q) > QUOTE_BLOCK:
            ws = ws or Workspace(spark, "containing")
            run(block).write.parquet(f"{ws.path}/found/block={found}")
            found, block, size = found + 1, [], 0
        block.append((name, q))
        size += len(q)
    if block:
        last = run(block)
    if ws is not None:
        last.write.parquet(f"{ws.path}/found/block={found}")
        last = spark.read.schema(schema).parquet(f"{ws.path}/found").select("quote", "id")
    out = last if last is not None else spark.createDataFrame([], schema)
    return out.select(F.col("quote").cast(kinds[0]).alias("quote"), "id").distinct()


def ranking_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), digits: int = 6) -> DataFrame:
    """For each query with gold documents: recall, hit and nDCG at each k, and the reciprocal rank within 10."""
    hits = gold.join(ranked.select("query", "id", "rank"), ["query", "id"], "left")
    ideal = lambda n, k: F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = [F.count("*").alias("units"), F.coalesce(F.max(F.when(F.col("rank") <= 10, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr_10")]
    got = hits.groupBy("query").agg(*out, *(F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks), *(F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"dcg_{k}") for k in ks))
    columns = [c for k in ks for c in (
        F.round(F.col(f"n_{k}") / F.col("units"), digits).alias(f"recall_{k}"),
        (F.col(f"n_{k}") > 0).cast("double").alias(f"hit_{k}"),
        F.round(F.col(f"dcg_{k}") / ideal(F.col("units").cast("int"), k), digits).alias(f"ndcg_{k}"),
    )]
    return got.select("query", "units", *columns, F.round("mrr_10", digits).alias("mrr_10"))


def graded_metrics(ranked: DataFrame, grades: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """For each query of ``grades`` (query, id, grade): hit, reciprocal rank and nDCG within k, with gains 2**grade - 1.  An id
    that a ranking repeats counts at its first place, and those behind it move up."""
    if k < 1:
        raise ValueError("k must be positive")
    first = ranked.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "id"))
    hits = first.withColumn("place", place).where(F.col("place") <= k)
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    x = grades.join(hits, ["query", "id"], "left")
    best = F.transform(F.slice(F.array_sort(F.collect_list(-F.col("grade"))), 1, k), lambda g, i: gain(-g) / F.log2(i + 2))
    g = x.groupBy("query").agg(
        F.min("place").alias("first"), F.coalesce(F.sum(gain(F.col("grade")) / F.log2(F.col("place") + 1)), F.lit(0.0)).alias("dcg"),
        F.aggregate(best, F.lit(0.0), lambda s, v: s + v).alias("ideal"),
    )
    return g.select(
        "query", F.col("first").isNotNull().cast("double").alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), digits).alias("mrr"),
        F.round(F.try_divide("dcg", F.col("ideal")), digits).alias("ndcg"),
    )


def resolved_judgments(judgments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, id, grade): judgments (query, document_id, chunk_id, grade) as grades of chunks (document_id, chunk_id); one
    without a chunk holds for all of its document's; the highest grade counts."""
    c = chunks.select("document_id", F.col("chunk_id").alias("id"))
    x = judgments.join(c, "document_id").where(F.col("chunk_id").isNull() | (F.col("chunk_id") == F.col("id")))
    return x.groupBy("query", "id").agg(F.max("grade").alias("grade"))


def unit_metrics(ranked: DataFrame, units: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), digits: int = 6) -> DataFrame:
    """Recall, hit and nDCG at each k and reciprocal rank of questions whose evidence is units (query, unit, ids), each met by
    any of its chunks.  For nDCG a place counts for one unit at most: the first open one that it meets.  The fold over a
    question's places is a few numbers long."""
    best = ranked.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    places = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank", "id")))
    x = units.withColumn("id", F.explode_outer("ids")).join(places.select("query", "id", "place"), ["query", "id"], "left")
    per = x.groupBy("query", "unit").agg(F.min("place").alias("first"), F.array_sort(F.collect_set("place")).alias("places"))
    g = per.groupBy("query").agg(F.count("*").alias("units"), F.collect_list("first").alias("firsts"), F.min("first").alias("least"), F.array_sort(F.collect_list(F.struct("unit", "places"))).alias("u"))
    met = F.array_sort(F.array_distinct(F.flatten(F.transform("u", lambda u: u["places"]))))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, p: Column) -> Column:
        open_ = F.filter(F.transform("u", lambda u, i: F.when(F.array_contains(u["places"], p) & ~F.array_contains(s["taken"], i), i)), lambda i: i.isNotNull())
        more = F.struct(F.concat(s["taken"], F.slice(open_, 1, 1)).alias("taken"), F.concat(s["at"], F.array(p)).alias("at"))
        return F.when(F.size(open_) > 0, more).otherwise(s)

    g = g.withColumn("at", F.aggregate(met, start, step, lambda s: s["at"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    columns = []
    for k in ks:
        n = F.size(F.filter("firsts", lambda f: f <= k))
        ideal = total(F.transform(F.sequence(F.lit(1), F.least(F.col("units").cast("int"), F.lit(k))), lambda i: 1 / F.log2(i + 1)))
        dcg = total(F.transform(F.filter("at", lambda p: p <= k), lambda p: 1 / F.log2(p + 1)))
        columns += [F.round(n / F.col("units"), digits).alias(f"recall_{k}"), (n > 0).cast("double").alias(f"hit_{k}"), F.round(dcg / ideal, digits).alias(f"ndcg_{k}")]
    mrr = F.when(F.col("least") <= 10, 1 / F.col("least")).otherwise(0.0)
    return g.select("query", "units", *columns, F.round(mrr, digits).alias("mrr_10"))


def run_ranks(ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """(query, quote, rank): the best rank of a quote by its runs (query, quote, run, id) of neighbouring chunks, a run being
    found where the last of its chunks is; null if no run is found whole."""
    x = runs.join(ranked.select("query", "id", "rank"), ["query", "id"], "left")
    per = x.groupBy("query", "quote", "run").agg(F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("rank"))
    return per.groupBy("query", "quote").agg(F.min("rank").alias("rank"))


def adaptive_context(ranked: DataFrame, score: str, gate: float, k: int, share: float | None = None) -> DataFrame:
    """Adds gated and kept: the first k of a ranking, and of them those with a score of at least ``share`` of the best one and
    of the gate; the best one always; nothing is published where the best is below the gate."""
    w = Window.partitionBy("query")
    best = F.max(score).over(w)
    inside = F.col("rank") <= k
    if share is not None:
        inside = inside & ((F.col(score) >= F.greatest(F.lit(gate), share * best)) | (F.col("rank") == F.min("rank").over(w)))
    return ranked.withColumns({"gated": best < gate, "kept": inside})
