import struct

import numpy as np
import pyarrow as pa
import pytest
from test_kernel import twins

from sediment.llm.unigram import Encoder, Vocabulary, double_array, encode, load_vocabulary, model_path, search_long

TEXTS = ["", None, " ", "  a  b ", "Hello world, hello", "日本語テキスト😀 x", "▁▁x▁ y", "a\n\n\tb", "<0x41> <s>", "x" * 300, "é́́ ñandú", "abc" * 500 + " " * 70, "aaaaaaaaaa", "\x00\x01", "the the the"]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(model_path())


def ids_of(v, texts):
    e, out = Encoder(v), []
    for _, ids, off, _, _ in e.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    return out


def test_trie_holds_its_keys_and_no_others():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    base, check, value = double_array(keys)

    def find(key):
        s = 0
        for c in key:
            t = base[s] + c
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert [find(k) for k in (b"", b"abcd", b"c", b"z", b"\xff", b"ba")] == [-1] * 6


def test_best_of_all_cuts_on_a_small_vocabulary():
    rng = np.random.default_rng(4)
    pieces = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aab", b"\xc3\xa9", b"a\xc3\xa9"]
    v = Vocabulary(pieces, np.arange(300, 300 + len(pieces)), -rng.random(len(pieces)).astype(np.float32) * 5 - 1, np.arange(256))

    def best(text):
        if not text:
            return 0.0
        options = [v.scores[k] + best(text[len(p) :]) for k, p in enumerate(pieces) if text.startswith(p)]
        size = 1 + (text[0] >= 0xC0) + (text[0] >= 0xE0)
        if text[:size] not in pieces:
            options.append(v.unknown + best(text[size:]))
        return max(options)

    def score(ids, text):
        total, at = 0.0, 0
        joined = b""
        k = 0
        while k < len(ids):
            if ids[k] >= 300:
                total += v.scores[ids[k] - 300]
                joined += pieces[ids[k] - 300]
                k += 1
            else:
                size = 1 + (ids[k] >= 0xC0) + (ids[k] >= 0xE0)
                total += v.unknown
                joined += bytes(ids[k : k + size])
                k += size
        assert joined == text and at == 0
        return total

    for _ in range(150):
        text = "".join(rng.choice(["a", "b", " ", "é", "ü", "日"], p=[0.4, 0.2, 0.15, 0.1, 0.1, 0.05]) for _ in range(rng.integers(1, 9)))
        whole = (" " + text).encode()
        (ids,) = ids_of(v, [text])
        assert abs(score(ids, whole) - best(whole)) < 1e-4
        assert abs(score(search_long(v, whole), whole) - best(whole)) < 1e-4


def _varint(b, i):
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _fields(b):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, tag & 7, value


def _put(f, w, value):
    return _number(f << 3 | w) + (_number(value) if w == 0 else _number(len(value)) + value if w == 2 else value)


def as_unigram(path, v):
    """The model file as a unigram model with the vocabulary's scores, for the library."""
    scores, out, k = dict(zip(v.ids.tolist(), v.scores.tolist())), b"", 0
    for f, w, value in _fields(open(path, "rb").read()):
        if f == 1:
            parts = [x for x in _fields(value) if x[0] != 2]
            if k in scores:
                parts.insert(1, (2, 5, struct.pack("<f", scores[k])))
            value, k = b"".join(_put(*x) for x in parts), k + 1
        elif f == 2:
            value = b"".join(_put(a, b, 1 if a == 3 else c) for a, b, c in _fields(value))
        out += _put(f, w, value)
    return out


def test_agrees_with_the_library(vocabulary):
    import sentencepiece
    from pyarrow import parquet

    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(model_path(), vocabulary))
    texts = [t or "" for t in TEXTS] + parquet.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    score = dict(zip(vocabulary.ids.tolist(), vocabulary.scores.tolist()))
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    for text, got in zip(texts, ids_of(vocabulary, texts)):
        want = library.encode(text)
        if got != want:  # a tie of equal scores
            assert sum(i not in score for i in got) == sum(i not in score for i in want) and abs(total(got) - total(want)) < 1e-2


def test_frame(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = encode(spark, df, decoded=True).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert sorted(r.text for r in got) == sorted((t or "").replace("▁", " ") for _, t, _ in rows)
    assert all(r.n_pieces == len(r.piece_ids) for r in got) and encode(spark, df.limit(0)).count() == 0


def test_twin_words_keep_their_own_text(spark):
    texts = [t for n in (1024, 2048) for t in twins(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = encode(spark, df, decoded=True).orderBy("doc_id").collect()
    assert [r.text for r in rows] == texts and all(r.round_trip for r in rows)
