"""Web pages as text: a tree of what the parser reports, written out by one rule for each kind of element."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: what isn't shown, what stands apart, and what has no content.
HIDDEN = frozenset(("script", "style", "nav", "header", "footer"))
APART = frozenset(("p", "div", "li", "tr"))
BEFORE = frozenset(("br", "section"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Most rows or columns that a cell covers.
MOST_SPAN = 50
#: What a part of a table ends when it begins inside of another one that was left open.
_ENDS = {tag: frozenset(x) for tag, x in {
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "thead": ("td", "th", "tr", "thead", "tbody", "tfoot"),
    "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot"),
}.items()}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None) -> None:
        self.tag, self.attrs, self.inner = tag, attrs or {}, []  # inner: nodes and strings

    def find(self, tags: frozenset[str]) -> Iterator[Node]:
        """Descendants of these tags in order, not looking into them or into tables inside."""
        todo = self.inner[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, Node) and x.tag in tags:
                yield x
            elif isinstance(x, Node) and x.tag != "table" and x.tag not in HIDDEN:
                todo += x.inner[::-1]


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("")
        self.open = [self.top]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if ends := _ENDS.get(tag):
            table = max((d for d, n in enumerate(self.open) if n.tag == "table"), default=0)
            if left := [d for d in range(table + 1, len(self.open)) if self.open[d].tag in ends]:
                del self.open[left[0] :]
        node = Node(tag, dict(attrs))
        self.open[-1].inner.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].inner.append(data)


def tree(html: str) -> Node:
    out = _Tree()
    out.feed(html)
    out.close()
    return out.top


def _written(node: Node, rule: Callable[[Node], tuple[str, list, str]]) -> str:
    """What stands below a node: ``rule`` gives for an element what comes before, inside and after."""
    out, todo = [], node.inner[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in HIDDEN:
            before, inner, after = rule(x)
            out.append(before)
            todo += [after, *inner[::-1]]
    return "".join(out)


def flat(node: Node) -> str:
    """All shown text below a node in one line; what stands apart is separated."""
    space = lambda x: " " if x.tag in APART | BEFORE | {"td", "th"} else ""
    return " ".join(_written(node, lambda x: (space(x), x.inner, space(x))).split())


def _span(value: str | None) -> int:
    return min(max(int(value), 1), MOST_SPAN) if value and value.strip().isdigit() else 1


def merged_header(rows: list[list[str]]) -> list[str]:
    """One header of several rows: the different texts above a column, from the top."""
    return [" / ".join(dict.fromkeys(filter(None, column))) for column in zip(*rows)]


def markdown_table(rows: list[list[str]], head: int = 1) -> str:
    """Rows as a Markdown table, filled up to the same width, the first ``head`` of them as its header."""
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    shown = [merged_header(rows[:head]), ["---"] * width, *rows[head:]]
    return "\n".join(f"| {' | '.join(r)} |" for r in shown)


def table_rows(table: Node) -> tuple[list[list[str]], int]:
    """The rows of a table and how many of them are its header.  A cell's text stands at every place that it covers; rows
    without text are left out; header rows are the first ones in a head or of header cells only."""
    rows = list(table.find(frozenset(("tr",))))
    heads = {id(r) for part in table.find(frozenset(("thead",))) for r in part.find(frozenset(("tr",)))}
    places: dict[tuple[int, int], str] = {}
    kinds: list[bool] = []
    for i, row in enumerate(rows):
        cells, column = list(row.find(frozenset(("td", "th")))), 0
        kinds.append(bool(cells) and (id(row) in heads or all(c.tag == "th" for c in cells)))
        for cell in cells:
            while (i, column) in places:
                column += 1
            text, wide = flat(cell).replace("|", "&#124;"), _span(cell.attrs.get("colspan"))
            tall = min(_span(cell.attrs.get("rowspan")), len(rows) - i)
            places |= {(i + y, column + x): text for y in range(tall) for x in range(wide)}
            column += wide
    out, head = [], []
    for i, kind in enumerate(kinds):
        width = 1 + max((c for r, c in places if r == i), default=-1)
        if any(cells := [places.get((i, c), "") for c in range(width)]):
            out.append(cells)
            head.append(kind)
    return out, (head.index(False) if False in head else len(head)) or 1


def _plain(x: Node) -> tuple[str, list, str]:
    if x.tag in HEADINGS:
        return f"\n\n{'#' * HEADINGS[x.tag]} ", x.inner, "\n\n"
    return ("\n\n" if x.tag in APART | BEFORE else " | " if x.tag in ("td", "th") else ""), x.inner, ("\n\n" if x.tag in APART else "")


def _with_tables(x: Node) -> tuple[str, list, str]:
    if x.tag in HEADINGS:
        return "", [f"\n\n{'#' * HEADINGS[x.tag]} {text}\n\n"] if (text := flat(x)) else [], ""
    if x.tag == "table":
        rows, head = table_rows(x)
        caption = " ".join(filter(None, map(flat, x.find(frozenset(("caption",))))))
        return "\n\n", [f"{caption}\n\n" if caption else "", markdown_table(rows, head)] if rows else [], "\n\n"
    return _plain(x)


#: What begins like a reference to a character and has no end: HTML still reads the old names among them.
_OPEN_REFERENCE = re.compile(r"&(?!#?\w+;)")


def html_text(html: str, tables: bool = False, ended: bool = False) -> str:
    """A page as Markdown-like text: headings with marks, blocks apart.  With ``tables``, headings are one line and tables
    are Markdown tables with their spans filled in; without, cells stand after bars.  With ``ended``, only references to
    characters that end with a semicolon count."""
    if ended:
        html = _OPEN_REFERENCE.sub("&amp;", html)
    text = re.sub(r"[ \t]+", " ", _written(tree(html), _with_tables if tables else _plain))
    return re.sub(r"\n\s*\n", "\n\n", text).strip() + "\n"


def html_documents(pages: DataFrame, key: str, html: str, tables: bool = False, ended: bool = False) -> DataFrame:
    """(key, text) of pages."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_text(x or "", tables, ended) for x in b.column(1).to_pylist()], pa.string())], names=["key", "text"])

    return pages.select(F.col(key).cast("string"), html).mapInArrow(convert, "key string, text string").withColumnRenamed("key", key)
