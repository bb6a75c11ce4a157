import re

import numpy as np
import pyarrow as pa
import pytest

from sediment.llm import kernel

TEXTS = ["", None, "  ", "a", "A b\tC\nd", "one two three four five six", " x yé É", "x" * 50, "a.b-c 1,2", "日本 語\x0b\x1cz"]


@pytest.mark.parametrize("cls, pattern", [(kernel.NON_SPACE, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("at_most", [1, 7, 1 << 20])
def test_words_are_those_of_the_pattern(cls, pattern, at_most):
    fold = {c: c + 32 for c in range(65, 91)}
    column = pa.array([*TEXTS, *TEXTS])
    got, names = [], {}
    for first, h, off in kernel.text_words(column.slice(1), cls, at_most):
        assert first == len(got)
        got += [h[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    want = [re.findall(pattern, (t or "").translate(fold)) for t in [*TEXTS, *TEXTS][1:]]
    assert [len(w) for w in got] == [len(w) for w in want]
    for hashes, words in zip(got, want):
        for h, w in zip(hashes, words):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_shingles_are_sets_of_five_words():
    texts = ["a b c d e f", "A  b c d E\nf", "a b c d e f a b c d e f", "a b", "a  B", "b a", "", None]
    sets = [s[o[k] : o[k + 1]].tolist() for _, s, o in kernel.shingle_sets(pa.array(texts)) for k in range(len(o) - 1)]
    assert sets[0] == sets[1] and len(sets[0]) == 2
    assert len(sets[2]) == 6 and set(sets[0]) <= set(sets[2])
    assert len(sets[3]) == 1 and sets[3] == sets[4] != sets[5]
    assert sets[6] == sets[7] == []


def test_spans_and_ranges():
    buf = np.frombuffer(b"abcABCabc", np.uint8)
    h = kernel.span_hashes(buf, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[2] != h[1]
    assert kernel.take_ranges(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]


def twins(n, a="a", b="b"):
    """Two complementary Thue-Morse words, equal under any polynomial hash modulo a power of two once they are long."""
    return tuple("".join(y if i.bit_count() & 1 else x for i in range(n)) for x, y in ((a, b), (b, a)))


@pytest.mark.parametrize("n", [7, 8, 9, 64, 256, 257, 1024, 2048, 4096])
def test_hashes_of_twin_words_differ(n):
    x, y = twins(n)
    assert kernel.word_hash(x) != kernel.word_hash(y) and kernel.word_hash(x) == kernel.word_hash(x.upper())
    buf = np.frombuffer((x + y + x).encode(), np.uint8)
    h = kernel.span_hashes(buf, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]
    a, b = (s[o[0] : o[1]].tolist() for t in (x, y) for _, s, o in kernel.shingle_sets(pa.array([t])))
    assert not set(a) & set(b)


def test_words_that_differ_in_any_byte_or_length():
    words = ["x" * n for n in range(1, 600)] + ["x" * k + "y" + "x" * (399 - k) for k in range(400)] + ["x" * k + "y" + "x" * (39 - k) for k in range(40)]
    h = [h.tolist() for _, h, _ in kernel.text_words(pa.array([" ".join(words)]), kernel.NON_SPACE)][0]
    assert len(h) == len(set(words)) == len(set(h))
