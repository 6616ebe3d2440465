"""Operators 11 to 13 against the library, plain Python and round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from attesto.llm import fill_in_middle as fim
from attesto.llm import queries as Q
from attesto.llm.fill_in_middle import fill_in_middle, restored
from attesto.llm.pieces import Encoder, decode_pieces, encode_pieces
from attesto.llm.vector_codes import VantageTree, compress_vectors, with_label_errors

from test_llm import KIND, corpus, frame, prose, rows

MODEL = Q.tokenizer("piece_bpe_32k.model")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def known():
    return Encoder(MODEL, memory=2000)


def ids(raw):
    return [np.frombuffer(x, "<i4").tolist() for x in raw]


def odd_texts():
    r = random.Random(3)
    parts = ["a", "th", "e", " ", "  ", " " * 17, " " * 40, "\n", "▁", "=", "==", "é", "日", "😀", "\x00", "\t", "ing", "tion", "<0x41>", "</s>", "<unk>", "ß", "http", "12", "̀", "�"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    texts += [" " * n + end for n in range(70) for end in ("", "foo", "\n", "日")] + [c * n for c in "=a-日" for n in range(1, 90, 7)]
    texts += ["".join(chr(r.choice([r.randint(0, 127), r.randint(128, 0xD7FF), r.randint(0x10000, 0x10FFFF)])) for _ in range(40)) for _ in range(300)]
    return texts + ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(2000)) for _ in range(5)]


def test_encoding_is_the_librarys(library, known):
    texts = odd_texts()
    assert ids(x for k in range(0, len(texts), 300) for x in known.encode(texts[k : k + 300])) == library.encode(texts)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "日" * 100_000, "\n" * 50_000, prose(1, 300_000), "loremipsumdolor" * 4000], ids=["letter", "blanks", "signs", "lines", "words", "one word"])
def test_long_texts(library, known, text):
    assert ids(known.encode(["x", text, ""])) == [library.encode("x"), library.encode(text), []]


def test_blocks_of_words(library, monkeypatch):
    """A text that is split into words in several blocks has the same ids."""
    from attesto.llm import pieces

    monkeypatch.setattr(pieces, "BLOCK", 50)
    texts = [t for t in odd_texts() if len(t) < 1000]
    assert ids(Encoder(MODEL).encode(texts)) == library.encode(texts)


def test_decoding_of_any_ids(library, known):
    r = random.Random(8)
    runs = [[r.choice([r.randint(0, 2), r.randint(3, 258), r.randint(0, 31999), 28705, 259]) for _ in range(r.randint(0, 12))] for _ in range(5000)]
    starts = np.cumsum([0, *map(len, runs)])
    assert known.pieces.decode(np.array([x for run in runs for x in run]), starts) == [library.decode(run) for run in runs]
    with pytest.raises(ValueError, match="vocabulary"):
        known.pieces.decode(np.array([32000]), np.array([0, 1]))


def test_pieces_of_frames(spark, library):
    docs = frame(spark, "", None, "a  b", "a  b", "日本", ids=[1, 2, None, 3, 3])
    got = decode_pieces(spark, encode_pieces(spark, docs, MODEL), MODEL)
    assert got.columns == ["doc_id", "ids", "text"]
    want = [(1, [], ""), (2, [], ""), (None, library.encode("a  b"), "a  b"), (3, library.encode("a  b"), "a  b"), (3, library.encode("日本"), "日本")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert decode_pieces(spark, encode_pieces(spark, docs.limit(0), MODEL), MODEL).count() == 0
    missing = spark.createDataFrame([(1, None), (2, [264]), (3, [])], "doc_id long, ids array<int>").coalesce(1)
    assert {r.doc_id: r.text for r in decode_pieces(spark, missing, MODEL).collect()} == {1: None, 2: library.decode([264]), 3: ""}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("codecs"))
    texts = corpus() + [prose(5, 9000), " lead\n\ntrail \t", "has <S> in it", " no blank here"] + [prose(s, s % 9) for s in range(200)]
    spark.createDataFrame(rows(*texts), KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, dict(enumerate(t or "" for t in texts))


def test_op11(spark, table, library):
    folder, texts = table
    got = {r.doc_id: tuple(r)[1:] for r in Q.op11_piece_codec(spark, folder).collect()}
    for i, text in texts.items():
        x = library.encode(text)
        assert got.pop(i) == (len(x), sha(",".join(map(str, x))), sha(library.decode(x)))
    assert not got


def plainly(text, doc_id, seed=42, rate=50, spm=80):
    """All units in a list, straight from the definition."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"{seed}:{doc_id}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_op13(spark, table):
    folder, texts = table
    got = {r.doc_id: tuple(r)[1:] for r in Q.op13_fill_in_middle(spark, folder).collect()}
    assert got.keys() == texts.keys() and {x[1] for x in got.values()} == {"plain", "spm", "psm"}
    for i, text in texts.items():
        n, form, p, m, out = plainly(text, i)
        assert got[i] == (n, form, p, m, sha(out), sha(text))


def test_fill_in_middle_of_odd_rows(spark):
    docs = frame(spark, "", None, "a b c", "a b c", "d e f", ids=[1, 2, None, 3, 3])
    made = fill_in_middle(spark, docs, seed=7, rate=100, spm_rate=0)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [(i, *plainly(t, i, 7, 100, 0)) for i, t in ((1, ""), (2, ""), (None, "a b c"), (3, "a b c"), (3, "d e f"))]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    assert fill_in_middle(spark, docs.limit(0)).count() == 0
    own = ("[[pre", "[[suf", "[[mid")
    texts = ["[[ [[su [[suf", "[[p", "x [[ [[mi [[pr", "< <P <S <M >"]
    for spm in (0, 100):
        out = fill_in_middle(spark, frame(spark, *texts * 30), rate=100, spm_rate=spm, marks=own).select(restored("output", "form", own).alias("t"))
        assert sorted(r.t for r in out.collect()) == sorted(texts * 30)
        out = fill_in_middle(spark, frame(spark, *texts * 30), rate=100, spm_rate=spm).select(restored("output", "form").alias("t"))
        assert sorted(r.t for r in out.collect()) == sorted(texts * 30)
    for marks in (("aa", "b", "c"), ("", "b", "c"), ("b", "b", "c"), ("xb", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(spark, docs, marks=marks)


def test_units_are_not_kept():
    import tracemalloc

    text = "ab " * 400_000
    tracemalloc.start()
    assert fim.number_of_units(text) == 400_001 and fim.ends_of_units(text, 100_000, 300_000) == (299_999, 899_999)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


@pytest.mark.parametrize("seed", range(30))
def test_tree_finds_the_nearest(seed):
    """Ties, repeated entries, few entries and numbers of all sizes, against all distances."""
    g = np.random.default_rng(seed)
    size = int(g.choice([1, 3, 100, 4096, 1 << 26]))
    entries = g.integers(-size, size + 1, (int(g.integers(1, 17)), int(g.integers(1, 9))))
    entries[g.integers(0, len(entries))] = entries[0]
    at = np.concatenate((g.integers(-size, size + 1, (500, entries.shape[1])), entries, (entries[:1] + entries) // 2))
    every = ((at[:, None] - entries[None]) ** 2).sum(axis=2)
    index, best = VantageTree(entries).nearest(at)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def coded(table, parts=8, entries=16, rounds=6):
    """(rows with codes and errors, books) in plain Python."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[j * width : (j + 1) * width] for j in range(parts)] for _, v, _ in kept]
    books = [[row[j] for row in cut[:entries]] for j in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(row[j], e)), k) for k, e in enumerate(books[j])) for j in range(parts)] for row in cut]

    for _ in range(rounds):
        groups = defaultdict(list)
        for row, found in zip(cut, assign()):
            for j, (_, k) in enumerate(found):
                groups[j, k].append(row[j])
        for (j, k), members in groups.items():
            books[j][k] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, bytes(k for _, k in found), sum(d for d, _ in found), label) for (i, _, label), found in zip(kept, assign())]
    total = defaultdict(int)
    for _, _, error, label in out:
        total[label] += error
    return [(*r, total[r[3]]) for r in out], books


VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, error string"


def vectors(spark, table):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in table], VECTORS)


@pytest.mark.parametrize("n", [1, 9, 16, 400])
def test_vector_codes(spark, n):
    g = random.Random(n)
    near = [[g.gauss(0, 0.3) for _ in range(16)] for _ in range(5)]
    table = [(i, [x + g.gauss(0, 0.05) for x in g.choice(near)], g.choice([1, 1, 2, None])) for i in range(n)]
    table = [(i, np.float32(v).tolist(), label) for i, v, label in table]
    table += [(5, None, 1), (6, [], 1), (None, table[0][1], None), (3, table[0][1], 2), (3, table[0][1], 2)]
    table += [(n, [0.5] * 15 + [x], 1) for x in (None, float("nan"), float("inf"), float("-inf"))]
    table = [r for r in table if r[1] != []]
    got = compress_vectors(spark, vectors(spark, table).repartition(5))
    want, books = coded(table)
    assert got.books.tolist() == books
    rows = with_label_errors(got.rows).select("id", "code", "error", "label", "label_error").collect()
    assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in rows), key=repr) == sorted(want, key=repr)


def test_vector_codes_of_odd_tables(spark):
    none = compress_vectors(spark, vectors(spark, [(1, None, 1)]))
    assert none.books.size == 0 and none.sha256 == sha("") and with_label_errors(none.rows).count() == 0
    same = compress_vectors(spark, vectors(spark, [(i, [0.0] * 8, None) for i in range(40)]))
    assert {(bytes(r.code), r.error, r.label_error) for r in with_label_errors(same.rows).collect()} == {(bytes(8), 0, 0)}
    for table, message in (([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], "equal parts"), ([(1, [1.0] * 9, 1)], "equal parts"), ([(1, [1e30] * 8, 1)], "too large")):
        with pytest.raises(ValueError, match=message):
            compress_vectors(spark, vectors(spark, table))


def test_op12_over_a_hot_label(spark, tmp_path):
    g = np.random.default_rng(4)
    table = [(i, np.float32(g.normal(0, 0.2, 64)).tolist(), 0 if i % 3 else i) for i in range(300)]
    vectors(spark, table).drop("id", "v", "error").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = coded(table)
    got = Q.op12_vector_codes(spark, str(tmp_path)).collect()
    digest = sha(",".join(str(x) for part in books for entry in part for x in entry))
    assert sorted(tuple(r) for r in got) == sorted((i, c.hex(), e, total, digest) for i, c, e, _, total in want)
