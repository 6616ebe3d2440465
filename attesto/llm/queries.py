"""The queries of the subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .decontaminate import contained_items
from .exact_dedup import exact_duplicates
from .fill_in_middle import fill_in_middle, restored
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pieces import decode_pieces, encode_pieces
from .secret_scan import KINDS, find_secrets
from .sharding import ShardStore
from .token_count import count_tokens
from .token_store import read_tokens, write_tokens
from .vector_codes import compress_vectors, with_label_errors
from .workspace import Workspace


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(spark, table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in four arrivals, merged; read back from the latest manifest."""
    store = ShardStore(spark, Workspace(spark, "shards").path)
    docs = table(spark, sf_dir, "documents")
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    store.compact()
    store.expire()
    text = F.coalesce("text", F.lit(""))
    return store.located().select("doc_id", F.col("__shard").alias("shard"), F.col("__tier").alias("tier"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path
    write_tokens(spark, table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    n = (F.octet_length("ids") / 4).cast("long")
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark, table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [number(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, toxicity.toxic_grades(table(spark, sf_dir, "labels")))
    return toxicity.score(spark, docs, model).select("doc_id", "severity", "grade", "toxic")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    coded = decode_pieces(spark, encode_pieces(spark, table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress_vectors(spark, table(spark, sf_dir, "embeddings"))
    rows = with_label_errors(codes.rows)
    code = F.lower(F.hex("code"))
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(codes.sha256).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark, table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END"

OP1_SQL = f"""
WITH RECURSIVE s AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT id, min(c) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id
"""

OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, l, {_WORDS.replace("coalesce(text, '')", "line")} AS w, line
  FROM (SELECT doc_id, unnest(range(len(a))) AS l, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
s AS (SELECT doc_id, l, {_SHINGLES} AS s FROM lines),
x AS (SELECT doc_id, l, len(s) AS n, unnest(s) AS g FROM s),
gone AS (
  SELECT DISTINCT doc_id, l FROM (
    SELECT a.doc_id, a.l FROM x a JOIN x b ON a.g = b.g AND (a.doc_id > b.doc_id OR a.doc_id = b.doc_id AND a.l > b.l)
    GROUP BY a.doc_id, a.l, b.doc_id, b.l, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))))
SELECT lines.doc_id, count(*) AS n_lines, count(gone.l) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.l) FILTER (WHERE gone.l IS NULL), '')) AS text_sha256
FROM lines LEFT JOIN gone USING (doc_id, l) GROUP BY lines.doc_id
"""

OP3_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS l, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY l DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, count(*) AS n_shared
FROM d JOIN b USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
"""



def _round(k: int) -> str:
    """Assignment by the codebooks of round ``k``."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT rid, part, entry, d FROM (
    SELECT rid, part, entry, d, row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) AS nth FROM (
      SELECT rid, p.part, entry, sum((x - y) * (x - y)) AS d FROM p JOIN b{k} b ON p.part = b.part AND p.pos = b.pos GROUP BY rid, p.part, entry))
  WHERE nth = 1)"""


def _means(k: int) -> str:
    """The codebooks after round ``k``."""
    return f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN (
    SELECT a.part, a.entry, p.pos, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS y
    FROM a{k} a JOIN p ON p.rid = a.rid AND p.part = a.part GROUP BY a.part, a.entry, p.pos) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""


OP12_SQL = f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT rid, i // (len(v) // 8) AS part, i % (len(v) // 8) AS pos, v[i + 1] AS x FROM (SELECT rid, v, unnest(range(len(v))) AS i FROM q)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x AS y FROM p WHERE rid <= 16),
{",".join(_round(k) + "," + _means(k) for k in range(6))},{_round(6)},
e AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b6) AS codebooks_sha256
FROM q JOIN e USING (rid)
"""

OP13_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || doc_id) AS h FROM documents),
n AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS r2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
    array_to_string(u[greatest(r1, r2) + 1:], '') AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_token_store": op5_token_store,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_count": op10_token_count,
    "op11_piece_codec": op11_piece_codec,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op9_decontaminate": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
