"""Token counts of a sentencepiece BPE model by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .encoders import piece_counts
from .workspace import slices


def _count(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    count = piece_counts(model).count
    for batch in slices(batches):
        numbers = [count(text) for text in batch.column(1).to_pylist()]
        size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(numbers, pa.int64())], schema=schema)


def count_tokens(spark: SparkSession, docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Pre-tokens that the vocabulary's proven list holds count as one; only others are merged, once for each worker
    that meets them (see ``PieceCounts``).  Rows stay where they are read.  Null texts are empty: 0 bytes, 0 tokens.
    Other columns are not read.
    """
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(lambda it: _count(it, model), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
