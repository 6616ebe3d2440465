"""Secrets in texts and in what their encoded parts unwrap to."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import string
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .workspace import slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_CONT = "%[89ABab][0-9A-Fa-f]"
#: Escapes of whole UTF-8 characters: of a run with other bytes, the valid stretches are decoded.
_URL = re.compile(
    rf"(?:%[0-7][0-9A-Fa-f]|%(?:[Cc][2-9A-Fa-f]|[Dd][0-9A-Fa-f]){_CONT}"
    rf"|%[Ee](?:0%[ABab][0-9A-Fa-f]|[1-9A-CEFa-cef]{_CONT}|[Dd]%[89][0-9A-Fa-f]){_CONT}"
    rf"|%[Ff](?:0%[9ABab][0-9A-Fa-f]|[1-3]{_CONT}|4%8[0-9A-Fa-f]){_CONT}{_CONT})+"
)
_UNICODE = re.compile(
    r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})"
    r"|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
#: Full lines and a last one of any length, or 16 characters in one line.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:((?:[A-Za-z0-9+/]{60,76}\r?\n)+)[A-Za-z0-9+/_-]+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2})")
#: What a run that can't be read whole is tried as: its stretches between / + - and _.
_STRETCH = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: A stretch of readable text that can hold a secret: the shortest has 14 characters, and none is longer decoded than
#: encoded.
_SOME = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f\ufffd]{14}")
#: Characters of secrets, escapes and base64 runs.
_INSIDE = string.ascii_letters + string.digits + "+/_.=-\"' :%\\{}&#;\r\n"
#: A layer that unpacks to more bytes is unpacked and scanned in pieces of about PIECE characters: a bound on what one
#: text can make a worker hold.
MOST_BYTES, PIECE = 1 << 24, 1 << 20
#: Bytes read at once; of Zstandard fewer, as a few bytes may stand for 128 KiB.
SLICE, ZSTD_SLICE = 1 << 16, 256


def find(text: str) -> list[tuple[str, int, int]]:
    """The secrets that stand in the text as it is: (kind, start, end) in code points."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES) or not low.isascii():  # a few letters outside ASCII have longer lower cases
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Places:
    """Where the characters of a layer stand in the original, as runs: run i begins at character first[i] and stands at
    start[i] to end[i], its characters one by one (single[i]) or each of them at the whole of it."""

    def __init__(self) -> None:
        self.first, self.start, self.end, self.single = array("q"), array("q"), array("q"), bytearray()

    @classmethod
    def of(cls, start: int, end: int, single: bool) -> Places:
        out = cls()
        out.add(0, start, end, single)
        return out

    def add(self, first: int, start: int, end: int, single: bool) -> None:
        self.first.append(first)
        self.start.append(start)
        self.end.append(end)
        self.single.append(single)

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Where the characters a to b stand."""
        i, j = bisect_right(self.first, a) - 1, bisect_right(self.first, b - 1) - 1
        start = self.start[i] + a - self.first[i] if self.single[i] else self.start[i]
        return start, self.start[j] + b - self.first[j] if self.single[j] else self.end[j]

    def copy(self, a: int, b: int, out: Places, at: int) -> None:
        """Add the runs of the characters a to b to ``out``, from its character ``at`` on."""
        i = bisect_right(self.first, a) - 1
        while a < b:
            stop = min(b, self.first[i + 1]) if i + 1 < len(self.first) else b
            shift = a - self.first[i]
            if self.single[i]:
                out.add(at, self.start[i] + shift, self.start[i] + shift + stop - a, True)
            else:
                out.add(at, self.start[i], self.end[i], False)
            at, a, i = at + stop - a, stop, i + 1

    def digest(self) -> bytes:
        return _digest(b"".join((self.first.tobytes(), self.start.tobytes(), self.end.tobytes(), self.single)))


class Layer:
    """A decoded text with its places.  A ``piece`` is one of many, to be dealt with before the next is made; a ``rough``
    one comes from bytes of which only stretches are text."""

    def __init__(self, text: str, places: Places, via: tuple[str, ...], piece: bool = False, rough: bool = False) -> None:
        self.text, self.places, self.via, self.piece, self.rough = text, places, via, piece, rough


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], str | None], via: str) -> Layer | None:
    """The layer with the matches decoded where they stand, or None if nothing changes."""
    parts, places, last, size = [], Places(), 0, 0

    def keep(stop: int) -> None:
        nonlocal last, size
        layer.places.copy(last, stop, places, size)
        parts.append(layer.text[last:stop])
        last, size = stop, size + stop - last

    for m in pattern.finditer(layer.text):
        if (new := decode(m)) is not None:
            keep(m.start())
            places.add(size, *layer.places.place(m.start(), m.end()), False)
            parts.append(new)
            last, size = m.end(), size + len(new)
    if not parts:
        return None
    keep(len(layer.text))
    return Layer("".join(parts), places, (*layer.via, via), rough=layer.rough)


def _url(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode()


def _unicode(m: re.Match) -> str | None:
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)
    n = int(m[8]) if m[8] else int(next(x for x in m.groups()[2:7] if x), 16)
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else None


def _bytes(encoded: str) -> bytes | None:
    """What a base64 run holds; a last character that makes no byte is left out."""
    raw = encoded.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    if len(raw) % 4 == 1:
        raw = raw[:-1]
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except binascii.Error:
        return None


class _Inflate:
    """zlib with the interface of the other decompressors."""

    def __init__(self) -> None:
        self.tool, self.needs_input = zlib.decompressobj(47), True

    eof = property(lambda self: self.tool.eof)
    unused_data = property(lambda self: self.tool.unused_data)

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.tool.decompress(self.tool.unconsumed_tail + data, most)
        self.needs_input = not self.tool.unconsumed_tail and len(out) < most
        return out


class _Zstd:
    """Zstandard likewise."""

    def __init__(self) -> None:
        import zstandard

        self.tool, self.data, self.needs_input = zstandard.ZstdDecompressor().decompressobj(), b"", True

    eof = property(lambda self: self.tool.eof)
    unused_data = property(lambda self: self.tool.unused_data + self.data)

    def decompress(self, data: bytes, most: int) -> bytes:
        data = self.data + data
        data, self.data = data[:ZSTD_SLICE], data[ZSTD_SLICE:]
        out = self.tool.decompress(data)
        self.needs_input = not self.data
        return out


def _tool(head: bytes):
    """(name, decompressor) of the format that bytes begin with, or None."""
    if head[:2] == b"\x1f\x8b":
        return "gzip", _Inflate
    if len(head) > 1 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib", _Inflate
    for magic, kind, make in ((b"BZh", "bzip2", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", "xz", lzma.LZMADecompressor), (b"\x28\xb5\x2f\xfd", "zstd", _Zstd)):
        if head.startswith(magic):
            return kind, make
    return None


class Source:
    """Bytes that can be read again and again in slices: held, or unpacked anew where they are many."""

    def __init__(self, data: bytes | None, again: Callable[[], Iterator[bytes]] | None = None) -> None:
        self.data, self.again = data, again

    def __call__(self) -> Iterator[bytes]:
        return self.again() if self.again else (self.data[i : i + SLICE] for i in range(0, len(self.data), SLICE))

    def digest(self) -> bytes:
        out = hashlib.blake2b(digest_size=16)
        for x in self():
            out.update(x)
        return out.digest()

    def after(self, n: int) -> Source:
        if self.data is not None:
            return Source(self.data[n:])

        def rest() -> Iterator[bytes]:
            left = n
            for x in self():
                if len(x) > left:
                    yield x[left:]
                left = max(left - len(x), 0)

        return Source(None, rest)


class _Feed:
    """The slices of a source, some of which may be given back; ``at`` counts the bytes taken, ``last`` of them by the last
    slice.  From ``single`` on, slices are bytes."""

    def __init__(self, source: Source, single: int | None = None) -> None:
        self.slices, self.data, self.at, self.last, self.single = source(), b"", 0, 0, single

    def head(self) -> bytes:
        while len(self.data) < 6 and (more := next(self.slices, b"")):
            self.data += more
        return self.data[:6]

    def take(self) -> bytes:
        out, self.data = self.data or next(self.slices, b""), b""
        if self.single is not None and self.at + len(out) > self.single:
            whole, self.single = out, None
            self.slices = chain((whole[k : k + 1] for k in range(1, len(whole))), self.slices)
            out = whole[:1]
        self.at += len(out)
        self.last = len(out)
        return out

    def back(self, data: bytes) -> None:
        self.data, self.at = data + self.data, self.at - len(data)

    def skip_zeros(self) -> None:
        """Members may be padded."""
        while self.head()[:1] == b"\0":
            self.back(self.take().lstrip(b"\0"))


def _member(feed: _Feed, make) -> Iterator[bytes]:
    tool = make()
    while not tool.eof:
        data = feed.take() if tool.needs_input else b""
        if tool.needs_input and not data:
            raise EOFError
        if out := tool.decompress(data, SLICE):
            yield out
    feed.back(tool.unused_data)


def _broken(error: Exception) -> bool:
    """Whether an error says that a member is cut off or damaged."""
    return isinstance(error, (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)) or type(error).__name__ == "ZstdError"


def _members(source: Source, n: int, single: int | None = None) -> Iterator[bytes]:
    feed = _Feed(source, single)
    try:
        for _ in range(n):
            yield from _member(feed, _tool(feed.head())[1])
            feed.skip_zeros()
    except Exception as error:
        if not _broken(error):
            raise


def unpack(source: Source) -> tuple[str, Source, Source | None] | None:
    """What the gzip, zlib, bzip2, xz or Zstandard members hold that a source begins with, one after the other, and what
    follows the last whole one.  Of a member that is cut off or damaged, what came of it is kept, and it counts as what
    follows, too, as its beginning may be a text's.  More than MOST_BYTES are not held, but unpacked again for each reader."""
    feed, name, good, used, size, kept, single = _Feed(source), "", 0, 0, 0, [], None
    while tool := _tool(feed.head()):
        n, mine, ends, began = 0, [], True, feed.at

        def given(parts: Iterator[bytes]) -> None:
            nonlocal n
            for out in parts:
                n += len(out)
                if size + n <= MOST_BYTES:
                    mine.append(out)

        try:
            given(_member(feed, tool[1]))
        except Exception as error:
            if not _broken(error):
                raise
            ends = False
            if not isinstance(error, EOFError):  # an error takes what its slice gave with it: again, byte by byte
                single, n, mine = feed.at - feed.last, 0, []
                given(_members(source.after(began), 1, single - began))
        if ends or n:
            name, good, size = name or tool[0], good + 1, size + n
            kept = [b"".join([*kept, *mine])] if size <= MOST_BYTES else []
        if not ends:
            break
        feed.skip_zeros()
        used = feed.at
    if not good:
        return None
    rest = source.after(used)
    inner = Source(b"".join(kept)) if size <= MOST_BYTES else Source(None, lambda: _members(source, good, single))
    return name, inner, rest if next(rest(), b"") else None


def _text(data: bytes) -> str | None:
    """Bytes that can be read: UTF-8 without control characters other than white space."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not _CONTROL.search(text) else None


def _pieces(source: Source) -> Iterator[str]:
    """The text of a long source in pieces of about PIECE characters.  They end with a character that is in no secret, escape
    or base64 run, nor will be when others are decoded, so nothing stands in two pieces; without such a character, a piece
    grows.  What is no UTF-8 becomes replacement characters, which are such."""
    decoder, held, size = codecs.getincrementaldecoder("utf-8")("replace"), [], 0
    for data in source():
        text = decoder.decode(data)
        if size + len(text) >= PIECE and (cut := len(text.rstrip(_INSIDE))):
            yield "".join([*held, text[:cut]])
            held, size, text = [], 0, text[cut:]
        held.append(text)
        size += len(text)
    held.append(decoder.decode(b"", True))
    yield "".join(held)


def _readable(source: Source) -> bool:
    decoder, some = codecs.getincrementaldecoder("utf-8")(), False
    try:
        for data in source():
            text = decoder.decode(data)
            some = some or bool(text)
            if _CONTROL.search(text):
                return False
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return some


def _opened(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (new := _replaced(layer, _URL, _url, "url")):
        yield new
    if ("\\" in text or "&#" in text) and (new := _replaced(layer, _UNICODE, _unicode, "unicode")):
        yield new
    at = 0
    while m := _BASE64.search(text, at):
        at = m.end()
        found, rough, whole = _encoded(layer, m.start(), at)
        if m[1] and not whole:  # the last line may be another text below the block
            end = m.start() + len(m[1].rstrip("\r\n"))
            less, parts, whole = _encoded(layer, m.start(), end)
            if whole or not found:
                found, rough, at = less, parts, end
        if not found and not m[1]:
            for part in _STRETCH.finditer(text, m.start(), at):
                if part.span() != m.span():
                    more, parts, _ = _encoded(layer, *part.span())
                    found, rough = found + more, rough + parts
        for k, (source, via, place) in enumerate(found + rough):
            for inside in (source.data.decode("utf-8", "replace"),) if source.data is not None else _pieces(source):
                if _SOME.search(inside):
                    yield Layer(inside, Places.of(*place, False), via, source.data is None, layer.rough or k >= len(found))


def _encoded(layer: Layer, start: int, end: int) -> tuple[list, list, bool]:
    """The sources that the base64 run holds, with their ways and place: those that can be read, those of which only
    stretches can, and whether all of it can be read.  Compressed bytes that were opened before on the way aren't opened
    again but read as text, so those that unpack to themselves end."""
    data, place, found, rough = _bytes(layer.text[start:end]), layer.places.place(start, end), [], []
    todo, seen = deque([(Source(data), (*layer.via, "base64"))] if data else []), set()
    whole = True
    while todo:
        source, via = todo.popleft()
        if _tool(next(source(), b"")[:6]) and (key := source.digest()) not in seen:
            seen.add(key)
            if inner := unpack(source):
                todo.append((inner[1], (*via, inner[0])))
                # A damaged member comes again as what follows; then it is looked at as text.
                todo.extend([(inner[2], via)] if inner[2] else [])
                continue
        readable = _text(source.data) is not None if source.data is not None else _readable(source)
        (found if readable else rough).append((source, via, place))
        whole = whole and readable
    return found, rough, whole and bool(found)


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def scan(text: str) -> list[tuple[str, int, int, bool, str]]:
    """All secrets as (kind, start, end, base, layers), places in code points of ``text``.

    A worklist opens each layer's URL and Unicode escapes (where they stand) and base64 runs, with what compressed
    bytes inside hold, and scans what comes out, until nothing new comes out.  A layer whose text and place were
    seen before isn't opened again, so cycles end; nothing else ends the search, neither depth nor size.  A secret of an inner layer has the place of the characters that
    it was decoded from; of those found on several ways, the first stays.  What stretches of a base64 run give isn't given
    again at the place of the whole run.
    """
    found: dict[tuple[str, int, int], tuple[bool, str, str, bool]] = {}
    _work(Layer(text, Places.of(0, len(text), True), ()), found, set())
    places: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for (kind, start, end), (_, _, secret, rough) in found.items():
        if not rough:
            places.setdefault((kind, secret), []).append((start, end))
    for of in places.values():
        of.sort()

    def closer(kind: str, start: int, end: int, secret: str) -> bool:
        of = places.get((kind, secret), [])
        k = bisect_left(of, (start,))
        return k < len(of) and of[k][1] <= end and of[k] != (start, end)

    out = [(*k, *v[:2]) for k, v in found.items() if not (v[3] and closer(*k, v[2]))]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _work(layer: Layer, found: dict, seen: set) -> None:
    todo = deque([layer])
    while todo:
        layer = todo.popleft()
        for kind, start, end in find(layer.text):
            found.setdefault((kind, *layer.places.place(start, end)), (not layer.via, ">".join(layer.via), layer.text[start:end], layer.rough))
        for inner in _opened(layer):
            key = (_digest(inner.text.encode()), inner.places.digest())
            if key not in seen:
                seen.add(key)
                if inner.piece:
                    _work(inner, found, seen)
                else:
                    todo.append(inner)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("layers", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPAN]
    for batch in slices(batches):
        rows = [[dict(zip(names, x)) for x in scan(text)] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["id", "spans"])


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, spans (kind, start, end, base, layers), by start, kind and end.

    Base spans stand in the text itself; the others were found in decoded layers, named from the outside in.  Of a layer
    that holds bytes which are no text, the stretches between them are scanned; of compressed data that are cut off or
    damaged, what comes out before.  Null
    and empty texts have no spans; rows that repeat an id are scanned each.  Rows stay where they are read.  Other
    columns are not read.
    """
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, "id long, spans array<struct<kind:string,start:long,end:long,base:boolean,layers:string>>").withColumnRenamed("id", id_col)
