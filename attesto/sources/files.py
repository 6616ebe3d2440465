"""Files of documents and logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

from ..operators.html import html_text, markdown_table

#: Names that are read as documents.
SUFFIXES = (".txt", ".md", ".markdown", ".html", ".htm", ".docx")
LARGEST = 20 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes, most: int = 100 << 20) -> str:
    """Paragraphs and tables of a word-processing file in order: headings with marks, tables with their spans filled in and
    their header rows merged, footnotes below the paragraph that refers to them."""
    w = _W
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > most:
            raise ValueError("the file unpacks to more than is allowed")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        notes = {}
        if "word/footnotes.xml" in z.namelist():
            for note in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{w}footnote"):
                notes[note.get(f"{w}id", "")] = " ".join("".join(x.text or "" for x in note.iter(f"{w}t")).split())

    def words(node) -> str:
        return "".join(x.text or "" if x.tag == f"{w}t" else "\t" for x in node.iter() if x.tag in (f"{w}t", f"{w}tab")).strip()

    def rows_of(table) -> tuple[list[list[str]], int]:
        rows, head = [], 0
        for i, row in enumerate(table.findall(f"{w}tr")):
            cells: list[str] = []
            for cell in row.findall(f"{w}tc"):
                wide = cell.find(f"{w}tcPr/{w}gridSpan")
                down = cell.find(f"{w}tcPr/{w}vMerge")
                text = words(cell).replace("|", "&#124;")
                if down is not None and down.get(f"{w}val") != "restart" and rows and len(cells) < len(rows[-1]):
                    text = rows[-1][len(cells)]  # the cell above goes on
                cells += [text] * (int(wide.get(f"{w}val", "1")) if wide is not None else 1)
            rows.append(cells)
            head += head == i and row.find(f"{w}trPr/{w}tblHeader") is not None
        return rows, max(head, 1)

    out = []
    for node in [] if body is None else body:
        if node.tag == f"{w}tbl":
            rows, head = rows_of(node)
            out.append(markdown_table(rows, head))
        elif node.tag == f"{w}p":
            named = [x.get(f"{w}id", "") for x in node.iter(f"{w}footnoteReference")]
            if lost := [x for x in named if x not in notes]:
                raise ValueError(f"a footnote is missing: {lost[0]}")
            text = " ".join(filter(None, [words(node), *(f"[^{x}]" for x in named)]))
            style = node.find(f"{w}pPr/{w}pStyle")
            level = re.search(r"(?i)(?:heading|заголовок)\s*(\d)", style.get(f"{w}val", "")) if style is not None else None
            if text:
                out.append("#" * int(level[1]) + " " + text if level else text)
            out += [f"[^{x}]: {notes[x]}" for x in named]
    return "\n".join(out)


def _decoded(path: str, data: bytes) -> tuple[str | None, str | None]:
    suffix = "." + path.rpartition(".")[2].lower()
    try:
        text = docx_text(data) if suffix == ".docx" else data.decode("utf-8-sig")
        text = html_text(text, tables=True) if suffix in (".html", ".htm") else text
    except (UnicodeDecodeError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
        return None, f"{type(error).__name__}: {error}"
    return (text, None) if text.strip() else (None, "no text")


def read_documents(spark: SparkSession, folder: str, largest: int = LARGEST) -> DataFrame:
    """(path, document_id, bytes, text, error) of the documents below a folder.  document_id is the SHA-256 of the bytes;
    a file that can't be read, or is too large, has an error instead of a text, and stops nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    known = F.lower(F.col("path")).rlike("(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$")
    fits = F.col("length") <= largest
    rows = files.where(known).select("path", F.sha2("content", 256).alias("document_id"), F.col("length").alias("bytes"), F.when(fits, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None, "too large") if c is None else _decoded(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x for x, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["path", "document_id", "bytes", "text", "error"])

    return rows.mapInArrow(run, "path string, document_id string, bytes long, text string, error string")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log by a fixed schema; lines that don't fit fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def not_done(cases: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Cases that the log doesn't have yet."""
    return cases.join(log.select(key).distinct(), key, "left_anti")


def select_cases(cases: DataFrame, ids: str, key: str = "id") -> DataFrame:
    """The cases that a list names, apart by commas or white space; ids of other datasets are ignored, but one of this dataset
    must be among them."""
    wanted = sorted({x for x in re.split(r"[,\s]+", ids) if x})
    some = cases.join(cases.sparkSession.createDataFrame([(x,) for x in wanted], "__id string"), F.col(key).cast("string") == F.col("__id"), "left_semi")
    if some.isEmpty():
        raise ValueError(f"none of the {len(wanted)} ids is in this dataset")
    return some


def split_failed(log: DataFrame, ok: str = "ok") -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and rows for the archive."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return log.where(good), log.where(~good)


def cached_scores(pairs: DataFrame, cache: DataFrame, score, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Scores of pairs, and the new cache rows: those that the cache (key, score) lacks are scored once each.  The key is
    a hash of the columns."""
    keyed = pairs.withColumn("key", F.sha1(F.concat_ws("\0", *columns)))
    known = keyed.join(cache, "key", "left")
    new = known.where("score is null").dropDuplicates(["key"]).select("key", score.alias("score"))
    return keyed.join(cache.unionByName(new), "key"), new


def manifest(spark: SparkSession, folder: str, exclude: str = r"(^|/)(\.git|__pycache__)/") -> DataFrame:
    """(path, bytes, sha256) of a folder's files by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(~F.col("path").rlike(exclude)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


#: What a case may be, by its category and by what is expected of it: fixed values.
BEHAVIOURS = {"unanswerable": ("refusal",), "adversarial": ("refusal_or_correction",), "lexical_trap": ("answer", "refusal")}
PROBE_LABELS = {"answer": "entailment", "refusal": "neutral", "refusal_or_correction": "contradiction"}


def check_dataset(cases: DataFrame, corpus: DataFrame, key: str = "id", document: str = "document_id") -> DataFrame:
    """(id, rule) of cases that break a rule.  Columns that a table of cases lacks make no rule break."""
    have = set(cases.columns)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) if c in have else F.lit(0)
    refusal = F.col("expected_behavior") == "refusal"
    allowed = F.coalesce(*(F.when(F.col("category") == c, F.col("expected_behavior").isin(*b)) for c, b in BEHAVIOURS.items()), F.col("expected_behavior") == "answer")
    rules = {
        "no_question": F.col("question").isNull() | (F.trim("question") == ""),
        "answer_without_facts": ~refusal & (n("answer_must_contain") == 0),
    }
    if "quotes" in have:
        rules["no_evidence"] = ~refusal & (n("quotes") == 0)
        rules["refusal_with_evidence"] = refusal & ((n("quotes") > 0) | (n("absence_terms") == 0))
        rules["one_quote_for_many_hops"] = (F.col("category") == "multi_hop") & (n("quotes") < 2)
    if "label" in have:
        rules["label_against_behaviour"] = ~F.coalesce(*(F.when(F.col("expected_behavior") == b, F.col("label") == v) for b, v in PROBE_LABELS.items()), F.lit(False))
    if "distortion" in have:
        rules["no_distortion"] = (F.col("category") == "adversarial") & (F.coalesce(F.trim("distortion"), F.lit("")) == "")
    if "category" in have:
        rules["behaviour_against_category"] = ~allowed
    names = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    broken = cases.select(F.col(key).alias("id"), F.explode(names).alias("rule"))
    twice = cases.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("id"), F.lit("duplicate_id").alias("rule"))
    lost = cases.join(corpus.select(document).distinct(), document, "left_anti").select(F.col(key).alias("id"), F.lit("unknown_document").alias("rule"))
    return broken.unionByName(twice).unionByName(lost)


def document_guard(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Adds problem to files (path, bytes): why one isn't read as a document; null if it is."""
    low = F.lower(F.col("path"))
    hidden = F.col("path").rlike(r"(^|/)\.[^/]+(/|$)")
    known = low.rlike("(" + "|".join(re.escape(x) for x in SUFFIXES) + ")$")
    return files.withColumn("problem", F.when(hidden, "hidden").when(~known, "unknown kind").when(F.col("bytes") == 0, "empty").when(F.col("bytes") > largest, "too large"))


#: Margins of a page, as shares of its height, and the share of a block that a table must cover to hold it.
MARGIN, COVERED = 0.08, 0.5


def page_layout(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, page, seq, kind, text) of pages in reading order, from what an extractor reports: ``blocks`` (document_id,
    page, pages, height, x0, y0, x1, y1, text) and ``tables`` with the same columns.

    Text that a table covers by more than half is the table's; page numbers at a margin go, and texts that stand at the
    margins of half of the pages (at least two).
    """
    b = blocks.withColumn("text", F.trim("text")).where("text <> ''").withColumn("block", F.monotonically_increasing_id())
    margin = (F.col("y0") < MARGIN * F.col("height")) | (F.col("y1") > (1 - MARGIN) * F.col("height"))
    often = b.where(margin).groupBy("document_id", "text").agg(F.countDistinct("page").alias("n"), F.max("pages").alias("p"))
    often = often.where(F.col("n") >= F.greatest(F.lit(2), F.floor((F.col("p") + 1) / 2))).select("document_id", "text", F.lit(True).alias("often"))
    x = b.join(often, ["document_id", "text"], "left")
    x = x.where(~(margin & (F.coalesce("often", F.lit(False)) | F.col("text").rlike(r"^[-–—\s]*\d+[-–—\s]*$"))))
    t = tables.select("document_id", "page", *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    over = F.greatest(F.lit(0.0), F.least("x1", "tx1") - F.greatest("x0", "tx0")) * F.greatest(F.lit(0.0), F.least("y1", "ty1") - F.greatest("y0", "ty0"))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1.0))
    held = x.join(t, ["document_id", "page"]).where(over / area > COVERED).select("block").distinct()
    free = x.join(held, "block", "left_anti").select("document_id", "page", "y0", "x0", F.lit("text").alias("kind"), "text")
    both = free.unionByName(tables.where(F.trim("text") != "").select("document_id", "page", "y0", "x0", F.lit("table").alias("kind"), "text"))
    seq = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("y0", "x0", "kind", "text")) - 1
    return both.select("document_id", "page", seq.alias("seq"), "kind", "text")


def unreadable_pages(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """(document_id, page) of pages that hold nothing after ``page_layout``: they need recognition of their images."""
    return blocks.select("document_id", "page").distinct().join(layout.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")


def document_titles(spark: SparkSession, folder: str, cache: DataFrame | None = None) -> DataFrame:
    """(path, changed, title) of the documents below a folder; those that ``cache`` has with the same time aren't read again."""
    from ..operators.experiments import title

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    known = F.lower(F.col("path")).rlike("(" + "|".join(re.escape(x) for x in SUFFIXES) + ")$")
    stamps = files.where(known).select("path", F.col("modificationTime").alias("changed"))
    old = None if cache is None else cache.join(stamps, ["path", "changed"], "left_semi").select("path", "changed", "title")
    new = stamps if old is None else stamps.join(old, ["path", "changed"], "left_anti")
    texts = read_documents(spark, folder).select("path", F.substring("text", 1, 8000).alias("text"))
    fresh = new.join(texts, "path").select("path", "changed", title("text").alias("title"))
    return fresh if old is None else old.unionByName(fresh)


CASE = t.StructType([
    t.StructField("id", t.StringType()), t.StructField("category", t.StringType()), t.StructField("language", t.StringType()), t.StructField("document_id", t.StringType()),
    t.StructField("question", t.StringType()), t.StructField("expected_behavior", t.StringType()), t.StructField("answer_must_contain", t.ArrayType(t.StringType())),
])
