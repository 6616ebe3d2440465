"""Encoding and decoding with a sentencepiece BPE model, by merge rounds over flat arrays.

All words that a batch of texts holds and a worker hasn't met lie one after another in one array of symbols.  A round
finds the least rank of a pair in each word, merges that pair wherever it stands in the word, from the left, and
compacts the arrays; words in which no pair is left go out.  The library merges one pair at a time, so where a merge
makes a pair that ranks as high or higher, only the word's leftmost merge of that round is done.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .encoders import LONGEST, MEMORY
from .workspace import slices

MARK = "▁"
#: The rank of a pair that isn't merged.
NONE = np.iinfo(np.int32).max
#: Characters of a text that are split into words at once.
BLOCK = 1 << 20
_WORD_END = re.compile(r"(?<=[^ \n])[ \n]")


def _decoded(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


class Pieces:
    """Tables of a model: characters, pairs, ranks and surfaces of pieces.

    What the tables rest on is checked: the model changes no character but blanks, puts a mark before a text, falls back
    to bytes, and every character of a piece is a piece.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = v = library.vocab_size()
        of = range(v)
        names = [library.id_to_piece(i) for i in of]
        byte = [library.is_byte(i) for i in of]
        self.control = np.array([library.is_control(i) for i in of])
        self.byte = np.array(byte)
        plain = {names[i]: i for i in of if not (byte[i] or self.control[i] or library.is_unknown(i))}
        probes = ("ﬁ² Å x", "é 　y", "  a  b ", "\x00\t\r\n")
        if any(library.decode(library.encode(x)) != x for x in probes) or library.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError(f"{path} changes characters, has no byte pieces or puts no mark before a text")
        if any(c not in plain for p in plain for c in p) or any(library.is_unused(i) for i in of):
            raise ValueError(f"{path} has pieces whose characters are none, or unused ones")
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in plain):
            raise ValueError(f"{path} has pieces that go over the start of a word")

        self.char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")] = self.char[ord(MARK)]
        self.first_byte = np.array([byte.index(True) + b for b in range(256)], np.int32)
        if [names[i] for i in self.first_byte] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError(f"{path} has byte pieces out of order")

        scores = {i: library.get_score(i) for i in plain.values()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = sorted(
            (plain[p[:k]] * v + plain[p[k:]], i, rank[scores[i]])
            for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain
        )
        self.keys, self.merged, self.ranks = (np.array(x) for x in zip(*pairs))
        self.inside = np.unique([plain[a] * v + plain[b] for p in plain for a, b in zip(p, p[1:])])

        # Pieces of blanks only tie for the lowest rank, so they are made from the left: a long run begins with the longest of
        # them, whatever follows, if that holds for the runs of up to three times its length.
        n = max(len(p) for p in plain if not p.strip(MARK))
        mark, longest = self.char[ord(MARK)], plain[MARK * n]
        runs = [self.merge(np.full(m, mark), np.arange(m) == 0)[0].tolist() for m in range(3 * n + 1)]
        tied = all(scores[i] == min(scores.values()) for p, i in plain.items() if len(p) > 1 and not p.strip(MARK))
        cut = tied and all(runs[m] == [longest, *runs[m - n]] for m in range(n, 3 * n + 1))
        self.words = re.compile(rf" {{{n}}}(?= )| {{1,{n}}}[^ \n]*|\n+[^ \n]*" if cut else r" +[^ \n]*|\n+[^ \n]*").findall

        shown = [b"" if self.control[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(MARK, " ").encode() for i in of]
        shown = [" ⁇ ".encode() if library.is_unknown(i) else x for i, x in enumerate(shown)]
        self.marked = np.array([names[i].startswith(MARK) for i in of])
        self.surface = np.frombuffer(b"".join(shown), np.uint8)
        self.length = np.array([len(x) for x in shown], np.int64)
        self.at = np.cumsum(self.length) - self.length

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of symbols becomes, and its rank."""
        key = left.astype(np.int64) * self.size + right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[k] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.merged[k], -1), np.where(known, self.ranks[k], NONE)

    def merge(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of ``symbols`` when no pair can be merged, and where each began.  ``start`` marks the first
        symbol of each word."""
        at = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        last = np.append(start[1:], True)
        piece, rank = self._pairs(symbols, np.append(symbols[1:], -1))
        rank = np.where(last, NONE, rank)
        while len(symbols):
            heads = np.flatnonzero(start)
            size = np.diff(heads, append=len(symbols))
            low = np.minimum.reduceat(rank, heads)
            out = np.repeat(low == NONE, size)
            if out.any():
                done.append((at[out], symbols[out]))
                symbols, at, start, piece, rank = (x[~out] for x in (symbols, at, start, piece, rank))
                size, low = size[low < NONE], low[low < NONE]
                if not len(symbols):
                    break
            word = np.repeat(np.arange(len(size)), size)
            hits = np.flatnonzero(rank == low[word])
            nth = np.arange(len(hits))
            run = np.maximum.accumulate(np.where(np.diff(hits, prepend=-2) != 1, nth, 0))
            hits = hits[(nth - run) % 2 == 0]  # of pairs that share a symbol, the left one
            while True:
                keep = np.ones(len(symbols), bool)
                keep[hits + 1] = False
                after = symbols.copy()
                after[hits] = piece[hits]
                after, first = after[keep], start[keep]
                new = hits - np.arange(len(hits))
                new = np.union1d(new, new[~first[new]] - 1)
                following = np.minimum(new + 1, len(after) - 1)
                joins, ranks = self._pairs(after[new], after[following])
                ranks[(new + 1 == len(after)) | first[following]] = NONE
                of = word[keep][new]
                # A merge also makes a pair with what stands to the right until that is merged itself.
                beyond = np.minimum(hits + 2, len(symbols) - 1)
                _, meanwhile = self._pairs(piece[hits], symbols[beyond])
                meanwhile[(hits + 2 == len(symbols)) | start[beyond]] = NONE
                early = np.zeros(len(size), bool)
                early[of[ranks <= low[of]]] = True
                early[word[hits[meanwhile <= low[word[hits]]]]] = True
                early &= np.bincount(word[hits], minlength=len(size)) > 1
                if not early.any():
                    break
                hits = hits[~early[word[hits]] | (np.diff(word[hits], prepend=-1) != 0)]
            symbols, at, start, piece, rank = after, at[keep], first, piece[keep], rank[keep]
            piece[new], rank[new] = joins, ranks
        if not done:
            return symbols, at
        at, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        return symbols[order], at[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        symbols = self.char[points]
        # No merge goes over two characters that stand together in no piece.
        inner = np.append(symbols[:-1].astype(np.int64) * self.size + symbols[1:], -1)
        k = np.minimum(np.searchsorted(self.inside, inner), len(self.inside) - 1)
        joined = (self.inside[k] == inner) & (symbols >= 0)
        start = np.append(True, ~joined[:-1])[: len(points)]
        start[ends[:-1]] = True
        ids, at = self.merge(symbols, start)
        ids, at = self._bytes(ids, at, points)
        cuts = np.searchsorted(at, ends) * 4
        raw = ids.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def _bytes(self, ids: np.ndarray, at: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become the pieces of their UTF-8 bytes."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, at
        parts = [chr(c).encode() for c in points[at[unknown]].tolist()]
        n = np.ones(len(ids), np.int64)
        n[unknown] = [len(x) for x in parts]
        ids, at, whole = np.repeat(ids, n), np.repeat(at, n), np.repeat(ids >= 0, n)
        ids[~whole] = self.first_byte[np.frombuffer(b"".join(parts), np.uint8)]
        return ids, at

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of runs of ids; run k is ``ids[starts[k]:starts[k + 1]]``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside of the vocabulary")
        length, at = self.length[ids], self.at[ids]
        # The mark that was put before a text goes: the first piece loses it, unless bytes come before.
        said = np.append(np.flatnonzero(~self.control[ids]), len(ids))
        first = np.unique(said[np.searchsorted(said, starts[:-1])])
        first = first[first < len(ids)]
        inside = np.searchsorted(starts, first, side="right") - 1
        first = first[(starts[inside + 1] > first) & self.marked[ids[first]]]
        length[first] -= 1
        at[first] += 1
        ends = np.append(0, np.cumsum(length))
        raw = self.surface[np.repeat(at - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        bounds = ends[starts].tolist()
        out, controls = [], np.append(0, np.cumsum(self.control[ids]))[starts]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            whole = _decoded(raw[a:b]) if controls[k] == controls[k + 1] else None
            if whole is None:  # ids that no text has
                whole = self._mended(ids[starts[k] : starts[k + 1]], ends[starts[k] : starts[k + 1] + 1], raw)
            out.append(whole)
        return out

    def _mended(self, ids: np.ndarray, ends: np.ndarray, raw: bytes) -> str:
        """A text in whose runs of byte pieces each byte that belongs to no character is a replacement character.  Control
        ids end a run."""
        out, is_byte = [], self.byte[ids]
        cuts = [0, *(np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            part, at = raw[ends[a] : ends[b]], 0
            while at < len(part):
                sizes = (1, 2, 3, 4) if is_byte[a] else (len(part),)
                found = next(((n, c) for n in sizes if (c := _decoded(part[at : at + n])) is not None), (1, "\ufffd"))
                at += found[0]
                out.append(found[1])
        return "".join(out)


class Encoder:
    """Ids of texts; words of up to ``LONGEST`` characters are remembered, up to ``MEMORY`` of them."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.pieces, self.memory = Pieces(path), memory
        self.known: dict[str, bytes] = {}

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some of them at a time; no merge goes over the start of one."""
        if text:
            text, at = " " + text.replace(MARK, " "), 0
            while at < len(text):
                cut = _WORD_END.search(text, at + BLOCK)
                end = cut.start() if cut else len(text)
                yield self.pieces.words(text, at, end)
                at = end

    def _meet(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that are new, if they are too long to be remembered; others are remembered."""
        new = [w for w in words if w not in self.known]
        if not new:
            return {}
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            new = list(words)
        found = dict(zip(new, self.pieces.encode_words(new)))
        self.known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return {w: x for w, x in found.items() if len(w) > LONGEST}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.  Words of all short texts are met at once."""
        out, waiting, size = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            for words in self._words(text):
                waiting.append((k, words))
                size += len(words)
                if size >= BLOCK >> 3:
                    self._settle(waiting, out)
                    waiting, size = [], 0
        self._settle(waiting, out)
        return out

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        long = self._meet(set().union(*(w for _, w in waiting)))
        known = {**self.known, **long}.__getitem__ if long else self.known.__getitem__
        parts: dict[int, list[bytes]] = {}
        for k, words in waiting:
            parts.setdefault(k, [out[k]] if out[k] else []).append(b"".join(map(known, words)))
        for k, x in parts.items():
            out[k] = b"".join(x)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DECODED = _ENCODED.append(pa.field("text", pa.string()))


def _encode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    known = encoder(model)
    for batch in slices(batches):
        raw = known.encode(batch.column(1).to_pylist())
        ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], schema=_ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    known = pieces(model)
    for batch in slices(batches):
        lists = batch.column(1)
        lists = pa.array(lists.to_pylist(), lists.type) if lists.null_count else lists
        ids, starts = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
        texts = known.decode(ids, (starts - starts[0]).astype(np.int64))
        empty = lists.is_null().to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if e else t for e, t in zip(empty, texts)], pa.string())], schema=_DECODED)


def encode_pieces(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and ``ids``, the ids that the sentencepiece library gives, without begin or end
    ids.  Rows stay where they are read.

    Null texts are empty and have no ids; null and repeated ids of documents stay as they are.  Other columns are not
    read.  Texts of any length are encoded whole, a block of words at a time.
    """
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, model), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(spark: SparkSession, encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and ``text``: what the library decodes the ids to.

    Control ids give nothing, the unknown id its sign, bytes that make no character a replacement character each; an id
    outside of the vocabulary is an error.  Null ids give a null text, no ids an empty one.  Other columns are not read.
    """
    ship(spark)
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: _decode(it, model), "id long, ids array<int>, text string").withColumnRenamed("id", id_col)
