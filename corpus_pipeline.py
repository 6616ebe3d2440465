"""From documents to packed training sequences in five stages, each over all that the one before it kept.

Stages decide row by row.  Where doc_id tells all rows apart, it is the key of a decision; where ids are missing or
repeat, each stage gives its rows a key of its own, in the order of ids, and takes it off again.  So rows without an id
can be dropped like others, and rows that share an id are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.llm import toxicity
from attesto.llm.decontaminate import contained_items
from attesto.llm.exact_dedup import exact_duplicates
from attesto.llm.near_dedup import near_duplicates
from attesto.llm.packing import pack_documents
from attesto.llm.queries import tokenizer
from attesto.llm.workspace import Workspace, keyed, with_ids


def _without(docs: DataFrame, key: str, dropped: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose keys are in ``dropped``, and without a key that was made for them."""
    ids = Workspace(docs.sparkSession, name).save(dropped.select(key).distinct(), "dropped")
    left = with_ids(docs, ids, "left_anti", key)
    return left if key == "doc_id" else left.drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade, by a model of the labelled ones, is 0.  Empty texts have grade 0; texts of any length are
    judged whole."""
    model = toxicity.fit(spark, docs, toxicity.toxic_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows, key = keyed(spark, docs, "toxic-rows")
    return _without(rows, key, toxicity.score(spark, rows, model, id_col=key).where("toxic"), "toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space; of empty texts, one."""
    rows, key = keyed(spark, docs, "copies-rows")
    return _without(rows, key, exact_duplicates(spark, rows, id_col=key).where("not kept"), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies; empty texts are near copies of nothing."""
    rows, key = keyed(spark, docs, "near-rows")
    return _without(rows, key, near_duplicates(spark, rows, id_col=key).where("not kept"), "near-copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item of the benchmark; empty texts and items contain, and are contained in, none."""
    rows, key = keyed(spark, docs, "contaminated-rows")
    found = contained_items(spark, rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _without(rows, key, found, "contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with a checksum of their ids.  An empty text is its end mark; a long one fills
    several sequences."""
    packed = pack_documents(spark, docs, tokenizer("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A fitted model and a tokenizer can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written and read again for the next, which then is the
    only reader of it."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.save(docs, f"stage-{k}")
            if k:
                ws.drop(f"stage-{k - 1}")
    return docs
