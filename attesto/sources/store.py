"""The stored index: chunks with their vectors, what was parsed and scored before, and sinks."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import Chunking
from ..functions import text as T
from ..operators.retrieval import checked_vector
from ..shipping import ship
from ..storage import Workspace, hadoop_fs
from .corpus_sink import CorpusSink
from .keyed import TRIES, Conflict, KeyedTable

FIELDS = "chunk_id string, document_id string, source string, ordinal int, expected int, text string, section_path array<string>, signature string, point_id string, vector array<float>"


class SignatureChanged(ValueError):
    """The table was made by another encoder: its vectors can't be searched by this one."""


def signature(encoder: str, dimension: int, **settings) -> str:
    """What vectors depend on, as a short name."""
    return hashlib.sha256(json.dumps([encoder, dimension, settings], sort_keys=True).encode()).hexdigest()[:16]


def repeated(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, n) of ids that a batch has more than once."""
    return chunks.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


class ChunkStore:
    """Chunks (document_id, source, ordinal, expected, text, section_path) by id, with vectors of one encoder.

    They are a :class:`KeyedTable` by document: documents are replaced and deleted whole, a change writes files for the
    buckets of its documents only, and of two writers on one version both are kept, one on top of the other.  A reader
    keeps the version that it has begun with until that is expired.  What is derived from chunks follows by
    :meth:`KeyedTable.changes` (see ``derived.LexicalIndex``).  Indexes of other kinds offer the same methods.
    """

    def __init__(self, spark: SparkSession, path: str, encode: Callable[[Column], Column], encoder: str, dimension: int, buckets: int = 64) -> None:
        self.spark, self.encode, self.dimension = spark, encode, dimension
        self.signature = signature(encoder, dimension)
        self.table = KeyedTable(spark, path, FIELDS, "document_id", "chunk_id", buckets)

    def version(self) -> int | None:
        return self.table.version().number or None

    def read(self, vectors: bool = False) -> DataFrame:
        """All chunks; the column of vectors is read only if asked for."""
        rows = self.table.read()
        return rows if vectors else rows.drop("vector")

    def check(self) -> None:
        """Raise :class:`SignatureChanged` if the stored vectors are another encoder's."""
        other = self.table.version().state.get("signature", self.signature)
        if other != self.signature:
            raise SignatureChanged(f"{other} is stored, {self.signature} is asked for")

    def add(self, chunks: DataFrame) -> int:
        """Put in chunks, whole documents at a time: stored ones of the same documents or ids go.  The whole batch is checked
        before anything is published: ids once each, vectors of the right length with finite values.  Vectors are made once,
        whoever writes meanwhile.  Ids that another document has are looked for among the stored ids alone."""
        self.check()
        if not repeated(chunks).isEmpty():
            raise ValueError("a chunk id stands twice in the batch")
        ws = Workspace(self.spark, "chunks")
        framed = T.with_context("text", F.nullif(F.array_join("section_path", " > "), F.lit("")))
        made = {"signature": F.lit(self.signature), "point_id": T.url_uuid("chunk_id"), "vector": checked_vector(self.encode(framed), self.dimension).cast("array<float>")}
        new = ws.save(chunks.withColumns(made).select(*self.table.schema.names), "new")
        whole = new.select("document_id", F.lit(None).cast("string").alias("chunk_id")).distinct()
        ids = new.select("chunk_id", F.col("document_id").alias("now"))
        for left in reversed(range(TRIES)):
            base = self.table.version()
            self.check()
            moved = self.table.read(base).select("document_id", "chunk_id").join(ids, "chunk_id").where(~F.col("document_id").eqNullSafe(F.col("now"))).select("document_id", "chunk_id")
            try:
                self.table.change(new, whole.unionByName(moved), {"signature": self.signature}, base)
                break
            except Conflict:
                if not left:
                    raise
        n = new.count()
        ws.drop("new")
        return n

    def delete(self, documents: DataFrame) -> int:
        """Take out documents (document_id); returns the number of chunks that went."""
        keys = documents.select("document_id").distinct()
        gone = self.table.lookup(keys).count()
        if gone:
            self.table.delete(keys)
        return gone

    def merge(self) -> int:
        return self.table.merge().number

    def expire(self, keep: int = 1, age: float = 3600) -> None:
        self.table.expire(keep, age)

    def catalogue(self) -> DataFrame:
        """(document_id, source, chunks) of documents that are stored whole, by name."""
        return catalogue(self.read())


def catalogue(chunks: DataFrame) -> DataFrame:
    """(document_id, source, chunks) of the documents of which all chunks are there, in the order of their folded names."""
    from ..streaming.ingest import index_status

    whole = index_status(chunks).where("complete").select("document_id", "chunks")
    names = chunks.groupBy("document_id").agg(F.min("source").alias("source"))
    return whole.join(names, "document_id").select("document_id", "source", "chunks").orderBy(T.fold("source"), "document_id")


def parse_key(digest: str | Column, config: Chunking, counter: str, version: str) -> Column:
    """The name under which a document's chunks are kept: a hash of its content and of all that parsing depends on."""
    d = F.col(digest) if isinstance(digest, str) else digest
    rest = json.dumps([asdict(config), counter, version], sort_keys=True)
    return F.substring(F.sha2(F.concat(F.lit("["), d, F.lit(", "), F.lit(rest), F.lit("]")), 256), 1, 20)


def parsed_once(docs: DataFrame, path: str, parse: Callable[[DataFrame], DataFrame], digest: str, config: Chunking, counter: str = "words", version: str = "1") -> DataFrame:
    """Chunks of documents (``digest``, ...) from the cache at ``path``, after those that it lacks were parsed and added to it.

    ``parse`` turns documents with a column ``key`` into chunks with one; the cache is a table for each setting.  Two runs
    that lack the same document may both parse it, but its chunks are added once."""
    folder = f"{path}/{hashlib.sha256(json.dumps([asdict(config), counter, version], sort_keys=True).encode()).hexdigest()[:20]}"
    keyed = docs.withColumn("key", parse_key(digest, config, counter, version))
    cache = KeyedTable(docs.sparkSession, folder, parse(keyed).schema, "key")
    new, base = cache.missing(keyed)
    cache.insert(parse(new.dropDuplicates(["key"])), base)
    return cache.lookup(keyed.select("key"))


def scored_once(pairs: DataFrame, path: str, score: Column, *columns: str) -> DataFrame:
    """``pairs`` with ``key``, a hash of the columns, and ``score``: from the cache at ``path``, after pairs that it lacks were
    scored, once for each key, and added to it.

    The scorer sees no other pairs; the result reads what was stored, so it doesn't run again.  Of two runs that score the
    same pair, the first one's score stays and is both runs' result.  Null columns count as missing ones.
    """
    keyed = pairs.withColumn("key", F.sha1(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns))))
    kind = keyed.select(score.alias("score")).schema["score"].dataType
    cache = KeyedTable(pairs.sparkSession, path, StructType([StructField("key", StringType()), StructField("score", kind)]), "key")
    new, base = cache.missing(keyed)
    cache.insert(new.dropDuplicates(["key"]).select("key", score.alias("score")), base)
    return keyed.join(cache.lookup(keyed.select("key")), "key")


# Sinks.

LARGEST_UPLOAD = 20 << 20


def land(spark: SparkSession, folder: str, name: str, data: bytes) -> str:
    """Put an uploaded file into the landing zone that the ingestion stream reads, below a folder named by its content;
    returns its path.  A content that is there already stays as it is."""
    if not data or len(data) > LARGEST_UPLOAD:
        raise ValueError("an upload is empty or too large")
    safe = "".join("_" if c in '<>:"|?*' or ord(c) < 32 else c for c in name.replace("\\", "/").rpartition("/")[2]).strip(" .")
    if not safe:
        raise ValueError("an upload needs a name")
    path = f"{folder.rstrip('/')}/{hashlib.sha256(data).hexdigest()}/{safe}"
    fs, p = hadoop_fs(spark, path)
    if fs.exists(p.getParent()):
        return path
    _, part = hadoop_fs(spark, f"{folder.rstrip('/')}/.{uuid.uuid4().hex}/{safe}")
    out = fs.create(part, False)
    out.write(bytearray(data))
    out.close()
    if not fs.rename(part.getParent(), p.getParent()):
        fs.delete(part.getParent(), True)
    return path


class NameClash(ValueError):
    """Two documents would be one file."""


def write_corpus(docs: DataFrame, path: str, name: str, text: str) -> None:
    """One Markdown file for each document below ``path``, in folders of the tasks that wrote them; what was there before goes.

    Names are cleaned for file systems; if that makes two documents' names one, :class:`NameClash` is raised before
    anything is written.  Files become visible together when all tasks are done (see ``CorpusWriter``), so a failed or
    repeated task leaves nothing.  Null names are ``_``, null texts empty.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "corpus")
    x = ws.save(docs.select(F.coalesce(T.safe_filename(name), F.lit("_")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")), "named")
    clash = x.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if clash:
        raise NameClash(", ".join(f"{r['n']} documents are named {r['name']}" for r in clash))
    ship(spark)
    spark.dataSource.register(CorpusSink)
    x.write.format("attesto_corpus").option("path", path).mode("overwrite").save()
    ws.drop("named")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files that :func:`write_corpus` wrote, empty ones too."""
    ship(spark)
    spark.dataSource.register(CorpusSink)
    return spark.read.format("attesto_corpus").option("path", path).load()


def write_summary(rows: DataFrame, path: str, how: str = "json") -> None:
    """A report as one file of JSON lines or CSV with a header."""
    if how not in ("json", "csv"):
        raise ValueError("how is 'json' or 'csv'")
    one = rows.coalesce(1).write.mode("overwrite")
    one.json(path) if how == "json" else one.option("header", True).csv(path)


def markdown_report(rows: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; one of more than ``most`` rows is an error, not a part of it."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows is no table for a page")
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *([shown(v) for v in r] for r in found)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
