"""Fill-in-the-middle: a text is cut at two of its units and put together with the middle last.

A text is matched twice and no unit is kept: the first pass counts the units, the second advances an iterator of
matches to the two ranks that were drawn and takes their ends.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .workspace import slices

#: A run of characters other than blanks with the blanks before it, or the blanks at a text's end.
UNITS = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 that depend on the seed and the id only."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))


def number_of_units(text: str) -> int:
    number = count()
    deque(zip(UNITS.finditer(text), number), maxlen=0)
    return next(number)


def ends_of_units(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first ``first`` and the first ``second`` units end; ``first`` isn't above ``second``."""
    matches, ends = UNITS.finditer(text), [0]
    for further in (first, second - first):
        ends.append(next(islice(matches, further - 1, None)).end() if further else ends[-1])
    return ends[1], ends[2]


def transformed(text: str, chance: tuple[int, int, int, int], rate: int, spm_rate: int, marks: tuple[str, str, str]) -> tuple:
    """n, form, characters of prefix and middle (None if plain), and the output."""
    n = number_of_units(text)
    if not text or any(m in text for m in marks) or chance[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = ends_of_units(text, *sorted((chance[0] % (n + 1), chance[1] % (n + 1))))
    p, s, m = marks
    if chance[3] % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def _transform(batches: Iterator[pa.RecordBatch], seed: int, *settings) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = batch.column(0).to_pylist()
        rows = [transformed(text.as_py(), draws(seed, i), *settings) for i, text in zip(ids, batch.column(1))]
        columns = zip(*((i, *row) for i, row in zip(ids, rows)))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def fill_in_middle(
    spark: SparkSession, docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col``, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    ``rate`` of a hundred texts are cut, ``spm_rate`` of a hundred of those with the suffix first; which, and where,
    depends on ``seed`` and the id alone, so a retried task gives the same rows, and rows of one id are cut at the same
    draws.  Null texts are empty; empty texts and texts that contain a mark are plain; a null id draws as ``None`` does.
    A text of any length is cut whole, with memory for itself and its output only.  Other columns are not read.
    """
    for m in marks:
        if not m or any(m.startswith(m[-k:]) for k in range(1, len(m))):
            raise ValueError(f"the mark {m!r} ends as it begins: outputs couldn't be taken apart")
    if len({*marks}) < 3 or any(a in b for a in marks for b in marks if a != b):
        raise ValueError("a mark contains another one")
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(lambda it: _transform(it, seed, rate, spm_rate, marks), schema).withColumnRenamed("id", id_col)


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of which ``fill_in_middle`` made ``output``: each mark is in it once, if it isn't plain."""
    p, s, m = marks
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, b, 1), a, -1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
