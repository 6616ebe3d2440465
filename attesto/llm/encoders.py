"""The libraries' token ids, with each distinct pre-token encoded once.

Stretches whose characters all lie in a repertoire where Python and the libraries agree on letters, digits, white
space, lower case and normal forms are split here; each new pre-token is encoded by the library and remembered.  The
words around any other character go to the library as they are: a text is cut only where white space follows a
character that surely is none, and no pre-token of these tokenizers goes on there.  Both ways give the library's ids;
the tests compare them.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Letters of Latin-1, Latin Extended-A and Cyrillic without those that normal forms or lower-casing change in length.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-žЀ-џ"
#: Marks that are neither letters nor digits nor white space in any version of Unicode.
MARKS = "«»¿¡–—‘’“”„…•°§©®±×÷€"
_SAFE = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}{MARKS}]*")
_UNSAFE = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}{MARKS}]")
_CUT = re.compile(rf"(?<=[!-~\w{MARKS}])[ \t\n\r]")
#: Pre-tokens remembered in a worker process (about 90 MB), and the characters of the longest of them.
MEMORY, LONGEST = 400_000, 64

#: Byte-level tokenizers show each byte as a printable character: itself where it has one, else the next from U+0100.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)}


def safe(text: str) -> bool:
    return _SAFE.fullmatch(text) is not None


def stretches(text: str) -> Iterator[tuple[bool, str]]:
    """The text in parts that no pre-token crosses, and whether a part is safe."""
    cuts = [m.start() for m in _CUT.finditer(text)]
    at = 0
    while m := _UNSAFE.search(text, at):
        k = bisect_right(cuts, m.start())
        start = max(cuts[k - 1], at) if k else at
        if start > at:
            yield True, text[at:start]
        while True:  # words with such characters that follow one another are one part
            end = cuts[k] if k < len(cuts) else len(text)
            following = _UNSAFE.search(text, end)
            if not following or k + 1 < len(cuts) and following.start() > cuts[k + 1]:
                break
            k = bisect_right(cuts, following.start())
        yield False, text[start:end]
        at = end
    if at < len(text):
        yield True, text[at:]


def _python_pattern(pattern: str) -> str:
    """The same pattern for ``re``, over the safe repertoire.  Letters and digits come first: most pre-tokens are such, and
    no contraction starts like them."""
    short = "'s|'t|'re|'ve|'m|'ll|'d|"
    if pattern.startswith(short):
        letters, digits, rest = pattern.removeprefix(short).split("|", 2)
        pattern = f"{letters}|{digits}|{short}{rest}"
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\t\n\r {LETTERS}0-9]")
    single = inside.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    return single.replace(r"\p{L}", rf"[{LETTERS}]").replace(r"\p{N}", "[0-9]")


class TokenIds(dict):
    """Maps a pre-token to its ids as little-endian 32-bit integers."""

    #: The pattern that byte-level tokenizers use where their file names none; a fixed value of the format.
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.half = memory // 2
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = before.get("pretokenizers", [before])
        parts = (normal or {}).get("normalizers", [normal] if normal else [])
        self.lower = any(x["type"] == "Lowercase" for x in parts)
        known = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in parts)
        pattern = None
        if known and not parts and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space"):
            pattern = self.BYTE_LEVEL
        elif known and len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space"):
            pattern = steps[0]["pattern"]["Regex"]
        self.split = re.compile(_python_pattern(pattern)).findall if pattern else None
        #: Strings that the library takes out of a text before it splits it.
        self.special = [x["content"] for x in spec.get("added_tokens", [])]

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            plain = word.isascii() and word.isprintable()
            shown = word.replace(" ", _BYTES[32]) if plain else word.encode().decode("latin-1").translate(_BYTES)
            out = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        if len(self) >= self.half:  # the older half makes room
            self.old = dict(self)
            self.clear()
        if len(word) <= LONGEST:
            self[word] = out
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.split is None or any(x in text for x in self.special):
            return self._whole(text)
        if safe(text):
            return self._split(text)
        return b"".join(self._split(x) if ok else self._whole(x) for ok, x in stretches(text))

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text.lower() if self.lower else text)))


class PieceCounts(dict):
    """Maps a pre-token of a sentencepiece BPE model to its number of tokens.

    Pieces hold the space mark only at their start, and none holds a line feed, so no merge crosses the start of a
    run of spaces or of line feeds, whatever else a text holds: the model changes no character, and a mark in a text
    is to it a space.  At the start, every vocabulary string that the library encodes alone as one token is entered
    with 1: those pre-tokens need no merge.  All others are merged by the library when first met.
    """

    MARK = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        # What the splitting rests on; otherwise the library gets every text whole.
        inner = any(re.search(f"[^{self.MARK}]{self.MARK}", p) or "\n" in p for p in plain)
        kept = self._number("a  b") == self._number("a") + self._number(" b") and self._number("\n") == 2
        same = all(self.library.decode(self.library.encode(x)) == x for x in ("ﬁ² Å\u00a0x", "e\u0301 \u3000y"))
        self.splits = not inner and kept and same
        self.split = re.compile(r" +[^ \n]*|\n+[^ \n]*").findall
        self.one = [" " + p[1:] for p in plain if len(p) > 1 and p[0] == self.MARK and self.MARK not in p[1:] and self._number(p[1:]) == 1]
        self.update(dict.fromkeys(self.one, 1))

    def _number(self, text: str) -> int:
        return len(self.library.encode(text))

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
            self.update(dict.fromkeys(self.one, 1))
        if word[0] == "\n":  # the library puts a mark before it
            n = self._number(word) - 1
        elif word.strip(" "):
            n = self._number(word[1:])
        else:
            n = self._number("a" + word) - self._number("a")
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text or not self.splits:
            return self._number(text)
        return sum(map(self.__getitem__, self.split(" " + text.replace(self.MARK, " "))))


@lru_cache(maxsize=4)
def token_ids(path: str, memory: int = MEMORY) -> TokenIds:
    return TokenIds(path, memory)


@lru_cache(maxsize=4)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)
