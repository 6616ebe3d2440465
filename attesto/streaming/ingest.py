"""Incremental ingestion with a ledger, and event-time monitoring."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..shipping import ship

LEDGER = "doc_id bigint, sha256 string, status string, batch bigint"


def ledger(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha256, status): the first document of each content is added, later ones are duplicates of it."""
    x = docs.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    first = x.groupBy("sha256").agg(F.min(key).alias("first"))
    return x.join(first, "sha256").select(key, "sha256", F.when(F.col(key) == F.col("first"), "added").otherwise("duplicate").alias("status"), F.col("first").alias("same_as"))


def ingest_batch(batch: DataFrame, number: int, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One batch outside of a stream: contents that the ledger has are duplicates, others are added once.  It reads the
    hashes of the whole ledger; many small batches are ``ingest_stream``'s.

    The batch writes its own partition, so repeating it after a failure replaces what it wrote: exactly once in effect.
    """
    spark = batch.sparkSession
    known = _read(spark, path).where(F.col("batch") < number).where("status = 'added'").select("sha256").distinct()
    x = batch.select(F.col(key).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    x = x.join(known.withColumn("old", F.lit(True)), "sha256", "left")
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("doc_id")) == 1
    out = x.withColumn("status", F.when(F.col("old").isNull() & first, "added").otherwise("duplicate"))
    out.select("doc_id", "sha256", "status").write.mode("overwrite").parquet(f"{path}/batch={number}")


def _read(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


#: Groups among which rows are spread that need no look at the state.
SPREAD = 1024


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``slot``, by which rows go to the state: the content for the first row of each content in a batch; others are
    duplicates whatever the state says, and are spread, so a content that many documents have makes no hot group."""
    for batch in batches:
        seen: dict[str, int] = {}
        ids, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        low = [(i is None, i or 0) for i in ids]
        for k, content in enumerate(contents):
            if content not in seen or low[k] < low[seen[content]]:
                seen[content] = k
        first = set(seen.values())
        slots = [c if k in first else f"-{(ids[k] or 0) % SPREAD}" for k, c in enumerate(contents)]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.string()), batch.column(0), batch.column(1)], names=["slot", "doc_id", "sha256"])


def _statuses(rows: DataFrame) -> DataFrame:
    """Statuses of a batch's rows (doc_id, sha256, first, new): with a row that says a content is new, the least of its ids is
    added.  One pass over rows as ``_dealt`` spread them."""
    key = F.when(F.col("first") | F.col("new"), F.col("sha256")).otherwise(F.concat(F.lit("-"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SPREAD)).cast("string")))
    w = Window.partitionBy("slot").orderBy(F.col("new").desc(), F.col("doc_id").asc_nulls_last())
    x = rows.withColumn("slot", key)
    x = x.withColumns({"n": F.row_number().over(w), "fresh": F.max("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))}).where(~F.col("new"))
    return x.select("doc_id", "sha256", F.when(F.col("first") & F.col("fresh") & (F.col("n") == 2), "added").otherwise("duplicate").alias("status"))


def write_batch(rows: DataFrame, number: int, path: str) -> None:
    """A micro-batch's part of the ledger; written again after a failure, it replaces itself."""
    rows.select("doc_id", "sha256", "status").write.mode("overwrite").parquet(f"{path}/batch={number}")


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Ingest a stream of documents into the ledger at ``path``; starts again where its checkpoint ends.

    Which contents were added is the query's state, kept by content in RocksDB below the checkpoint: a batch reads and
    writes the entries of its own contents, however long the ledger is, and never the ledger.  A batch that is repeated
    after a failure finds the state as it was before, and replaces its part of the ledger.  Of rows with one content that
    come together, the one with the least id is added (null last).  The state is Spark's own for distinct rows, so no content is a
    call of Python; a row for each content that is new goes beside the batch's rows, which are read for both.
    """
    spark = docs.sparkSession
    ship(spark)
    x = docs.select(F.col(key).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    dealt = x.mapInArrow(_dealt, "slot string, doc_id long, sha256 string")
    first, yes, no = F.col("slot") == F.col("sha256"), F.lit(True), F.lit(False)
    rows = dealt.select("doc_id", "sha256", first.alias("first"), no.alias("new"))
    new = dealt.where(first).select("sha256").dropDuplicates(["sha256"]).select(F.lit(None).cast("long").alias("doc_id"), "sha256", no.alias("first"), yes.alias("new"))
    step = lambda batch, number: write_batch(_statuses(batch), number, path)
    query = rows.unionByName(new).writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return query.start()
    finally:
        spark.conf.set(provider, before)


def index_status(chunks: DataFrame) -> DataFrame:
    """(document_id, chunks, complete) of stored chunks (document_id, ordinal, expected): complete if all agree on the
    number and the ordinals are 0 to it, and if a stored hash (``content_hash``, if there is such a column) is the id."""
    g = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.min("expected").alias("e1"), F.max("expected").alias("e2"))
    whole = (F.col("e1") == F.col("e2")) & (F.col("chunks") == F.col("e1")) & (F.col("d") == F.col("chunks")) & (F.col("a") == 0) & (F.col("b") == F.col("chunks") - 1)
    complete = F.coalesce(whole, F.col("e1").isNull() & F.col("e2").isNull())
    if "content_hash" in chunks.columns:
        hashes = chunks.groupBy("document_id").agg(F.bool_and(F.coalesce(F.col("content_hash") == F.col("document_id"), F.lit(True))).alias("own"))
        g = g.join(hashes, "document_id")
        complete = complete & F.col("own")
    return g.select("document_id", "chunks", complete.alias("complete"))


def index_totals(chunks: DataFrame) -> DataFrame:
    """One row: documents stored whole and their chunks, documents stored in part, and all stored chunks."""
    s = index_status(chunks)
    done = F.col("complete")
    return s.agg(F.count_if(done).alias("documents"), F.coalesce(F.sum(F.when(done, F.col("chunks"))), F.lit(0)).alias("chunks"), F.count_if(~done).alias("incomplete"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("stored"))


def merge_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chunks with those of ``new`` in place of all of the same documents."""
    return stored.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def commit_report(ledger_rows: DataFrame) -> DataFrame:
    """(batch, added, duplicates, last): what each micro-batch committed; after a failure, what is done is the batches that are
    here."""
    return ledger_rows.groupBy("batch").agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.max("doc_id").alias("last")).orderBy("batch")


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, peak and mean of values by event type in each window; windows close when the watermark passes them."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.max("value").alias("peak"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "peak", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users as they close."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
