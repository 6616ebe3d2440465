"""Exact deduplication over recipes of content-defined chunks, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, join_groups, with_ids

#: What the comparison leaves out of a text.
SPACE = r"[\x20\x09-\x0D]"
#: A chunk ends with the first boundary past LEAST bytes, or at MOST.
LEAST, MOST = 256, 4096


def _bytes(rule) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if rule(b)) + "]"


#: A boundary is picked by residues of three of five neighbouring bytes of UTF-8: content alone decides, so equal passages
#: are cut alike wherever they stand.  Every other byte counts, so that scripts in which all characters begin with the
#: same byte have boundaries too: one in 100 to 200 characters in every script.
BOUNDARY = _bytes(lambda b: b % 4 == 1) + "." + _bytes(lambda b: b % 8 == 6) + "." + _bytes(lambda b: b % 8 in (0, 3))


def normal(text: str | Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE + "+", "")


def chunks(norm: Column) -> Column:
    """The content-defined chunks of a text in order, as strings with a character for each byte of UTF-8; joined, they are
    the text."""
    one = F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(one, F.lit(f"(?s).{{{LEAST},{MOST - 5}}}?{BOUNDARY}|.{{1,{MOST}}}"), F.lit(0))


def exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Of texts that are equal without white space, the one with the most code points stays, then the smallest id (null
    ids last).  Each document becomes a recipe: the hashes of its chunks in order, made in its row.  Only documents
    that share a recipe's hash can be equal; only their chunks move, once, with equal chunks of a task merged first,
    to find hashes that stand for two contents.  A chunk's verified identifier is its hash and its rank among the
    contents of that hash.  Groups are documents with equal identifier lists.  Null texts are empty; empty texts are
    one group.  Rows with the same id are separate members of a group.  Other columns are not read.  A group that
    holds a large share of all rows is summed up in the tasks that read it, and its result is broadcast to them.
    """
    ws = Workspace(spark, "exact-dedup")
    norm = normal(text_col)
    read = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("length"), norm.alias("norm"))
    recipes = read.select("id", "length", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: F.xxhash64(c)).alias("recipe"))
    recipes = ws.save(recipes.withColumns({"key": F.xxhash64("recipe"), "size": F.size("recipe")}), "recipes")

    # Chunks of the documents that may have an equal.
    counted = ws.save(recipes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    shared = ws.save(join_groups(recipes.select("id", "key", "size"), counted, ["key", "size"], "n", "left_semi").select("id").distinct(), "shared")
    texts = with_ids(docs.select(F.col(id_col).alias("doc"), normal(text_col).alias("norm")), shared, "left_semi", "doc")
    contents = texts.select("doc", F.posexplode(chunks(F.col("norm"))).alias("at", "chunk")).withColumn("hash", F.xxhash64("chunk"))
    distinct = contents.groupBy("hash", "chunk").agg(F.lit(1).alias("one"))
    doubtful = distinct.groupBy("hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("chunk")).alias("contents")).where("n > 1")
    doubtful = ws.save(doubtful.select("hash", "contents"), "doubtful")
    known = recipes.withColumn("ranks", F.lit(None).cast("array<struct<at:int,rank:long>>"))
    if not doubtful.isEmpty():
        # Hashes of two contents are next to never found; their documents get the ranks of those chunks.
        rank = F.struct("at", F.array_position("contents", F.col("chunk")).alias("rank"))
        ranks = contents.join(doubtful, "hash").groupBy("doc").agg(F.array_sort(F.collect_list(rank)).alias("ranks"))
        known = ws.save(recipes.join(ranks, recipes["id"].eqNullSafe(ranks["doc"]), "left").drop("doc"), "known")

    # A document whose recipe's hash no other one has is a group of its own: only the rest is grouped and joined.
    best = F.struct((-F.col("length")).alias("l"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    rows = known.withColumn("member", F.xxhash64("key", "recipe", "ranks"))
    groups = rows.groupBy("key", "member", "recipe", "ranks").agg(F.min(best)["id"].alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = ws.save(groups.groupBy("key", "member").agg(F.collect_list(F.struct("recipe", "ranks", "keep_id", "group_size")).alias("groups"), F.sum("group_size").alias("n")), "groups")
    found = join_groups(rows.select("id", "text_sha256", "recipe", "ranks", "key", "member"), groups, ["key", "member"], "n", "left")
    # Recipes and ranks themselves tell the groups of one hash apart.
    own = F.filter("groups", lambda g: (g["recipe"] == F.col("recipe")) & g["ranks"].eqNullSafe(F.col("ranks")))
    x = found.select("id", "text_sha256", F.try_element_at(own, F.lit(1)).alias("g"))
    alone = F.col("g").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("g")["keep_id"])
    x = x.select("id", keep.alias("keep_id"), F.when(alone, F.lit(1)).otherwise(F.col("g")["group_size"]).cast("long").alias("group_size"), "text_sha256")
    return x.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
