"""Words and five-word shingles of whole texts as 64-bit hashes, vectorised over UTF-8 bytes.

A-Z are lower-cased; words are maximal runs of bytes other than space and 0x09-0x0D.  Both rules touch ASCII only,
so they hold on UTF-8 as they do on code points.  A set with fewer than five words is its whole sequence as one
shingle; no word gives the empty set.  Hashes have 64 well-mixed bits: two different shingles of any two documents
of 20,000 words collide with a probability below 1e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_U = np.uint64
_BASE, _M = 0x9E3779B97F4A7C15, 1 << 64
_SHINGLE = 0xD6E8FEB86659FD93
#: Bytes hashed at a time; bounds memory for texts of any length.
STEP = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW, _INV = _powers(_BASE, STEP + 1), _powers(pow(_BASE, -1, _M), STEP + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _hash(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of at most STEP bytes; a word also ends at each cut (ascending, in range)."""
    ok = ~_SPACE[b]
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1]
    last[:-1] &= ~ok[1:]
    first[cuts] = ok[cuts]
    before = cuts[cuts > 0] - 1
    last[before] = ok[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum((_LOWER[b].astype(_U) + _U(1)) * _POW[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * _INV[starts] + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F)), starts


def _long_words(b: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, in segments that end between words."""
    parts, at = [], 0
    while at < len(b):
        end = min(len(b), at + STEP)
        if end < len(b) and not _SPACE[b[end]]:
            gaps = np.flatnonzero(_SPACE[b[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than STEP: the same polynomial, block by block
                while end < len(b):
                    gap = np.flatnonzero(_SPACE[b[end : end + STEP]])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end = min(len(b), end + STEP)
                h, scale, unit = 0, 1, pow(_BASE, STEP, _M)
                for i in range(at, end, STEP):
                    block = b[i : min(end, i + STEP)]
                    h = (h + scale * int(((_LOWER[block].astype(_U) + _U(1)) * _POW[: len(block)]).sum(dtype=_U))) % _M
                    scale = scale * unit % _M
                parts.append(mix(np.array([(h + (end - at) * 0xA0761D6478BD642F) % _M], dtype=_U)))
                at = end
                continue
        parts.append(_hash(b[at:end], np.zeros(1, dtype=np.int64))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each text in order."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        j = min(j, n)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo > STEP:
            yield _long_words(data[lo:hi])
        elif hi == lo:
            for _ in range(i, j):
                yield np.zeros(0, _U)
        else:
            at = offsets[i : j + 1] - lo
            hashes, starts = _hash(data[lo:hi], np.unique(at[:-1][at[:-1] < hi - lo]))
            ends = np.searchsorted(starts, at[1:])
            a = 0
            for e in ends:
                yield hashes[a:e]
                a = int(e)
        i = j


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a word sequence."""
    return np.unique(shingles(words))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The shingle hashes of a word sequence, in order."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, _U)
    m = len(words) - n + 1
    out = np.full(m, n, dtype=_U)
    for j in range(n):
        out = out * _U(_SHINGLE) + words[j : j + m]
    return mix(out)
