"""Vectorised text kernel: words of many texts as 64-bit hashes, in numpy.

Texts stay UTF-8 bytes. Word classes are sets of bytes, so a split by bytes is a split by code points
as long as every byte from 0x80 on is either always or never a word byte, which both classes below obey.
A word's hash takes in its length and its bytes, eight at a time, each time through a bijective finaliser.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: A-Z count as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: `[^\x20\x09-\x0D]+`
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True

#: Bytes handled at once: bounds the numpy buffers whatever a batch or one text holds.
CHUNK = 1 << 20
#: Bytes of a span up to which its lanes are hashed in numpy, all spans at once; a longer one is hashed by itself.
SHORT = 256
#: The bytes of a lane that belong to a span of which 0 to 8 bytes are left.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Seeds: of words, the same on all machines, and of spans, which never leave their process, so that no text can be made to collide.
_WORDS, _SPANS = 0x51ED270B7F4A7C15, int.from_bytes(os.urandom(8), "little")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of spans of buf: length and all bytes, eight at a time, go through the finaliser one after another."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))
    h = mix(h ^ (lanes[starts] & _KEEP[np.minimum(length, 8)]))
    rows = np.flatnonzero((length > 8) & (length <= SHORT))
    at, left = starts[rows] + 8, length[rows] - 8
    while len(rows):
        h[rows] = mix(h[rows] ^ (lanes[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(length > SHORT).tolist():
        h[k] = U(xxhash.xxh3_64_intdigest(padded[starts[k] : ends[k]], seed))
    return h


def hash_words(buf: np.ndarray, breaks: np.ndarray, cls: np.ndarray, cut: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words in buf; breaks: where texts begin, so that no word spans two.

    With cut, the hashes are those of the words' first `cut` bytes.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = cls[buf]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    breaks = breaks[breaks < n]
    before[breaks] = False
    starts = np.flatnonzero(word & ~before)
    last = np.empty(n, dtype=bool)
    last[-1], last[:-1] = True, ~word[1:]
    last[breaks[breaks > 0] - 1] = True
    ends = np.flatnonzero(word & last) + 1
    if cut:
        ends = np.minimum(ends, starts + cut)
    return _hash(_LOWER[buf], starts, ends, _WORDS), starts, ends


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Case-sensitive hashes of given spans of buf; they hold in this process only."""
    return _hash(buf, starts, ends, _SPANS)


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def word_hash(word: str, cls: np.ndarray = ALNUM) -> int:
    """The hash that hash_words gives the one word in this text."""
    h, _, _ = hash_words(np.frombuffer(word.encode(), np.uint8), np.zeros(1, np.int64), cls)
    assert len(h) == 1, word
    return int(h[0])


def _string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind, width = np.int32, 4
    else:
        kind, width = np.int64, 8
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    _, offsets, values = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind, count=n + 1, offset=column.offset * width).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def text_words(column: pa.Array, cls: np.ndarray, at_most: int = CHUNK, cut: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of whole texts as (first row, word hashes, offsets of each text's words).

    A group holds texts of at_most bytes in all, or one longer text, which is hashed piece by piece.
    """
    for first, h, off, _, _ in text_spans(column, cls, at_most, cut):
        yield first, h, off


def text_spans(
    column: pa.Array, cls: np.ndarray, at_most: int = CHUNK, cut: int = 0
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """text_words, with each word's start and end among the bytes of its group (of its prefix, with cut)."""
    data, off = _string_parts(column)
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + at_most, side="right")) - 1
        end = max(end, row + 1)
        lo, hi = int(off[row]), int(off[end])
        buf, starts_at = data[lo:hi], off[row:end] - lo
        if hi - lo <= at_most:
            h, starts, ends = hash_words(buf, starts_at, cls, cut)
        else:
            h, starts, ends = _long_text(buf, cls, at_most, cut)
        counts = np.searchsorted(starts, np.append(starts_at, hi - lo), side="left")
        yield row, h, counts, starts, ends
        row = end


def _long_text(buf: np.ndarray, cls: np.ndarray, at_most: int, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash_words of one long text, cut at separators into pieces of about at_most bytes."""
    parts, lo, n = [], 0, len(buf)
    while lo < n:
        hi = min(n, lo + at_most)
        while hi < n and cls[buf[hi]]:  # a word ends first, however long it is
            stop = np.flatnonzero(~cls[buf[hi : hi + 4096]])
            hi = hi + int(stop[0]) if len(stop) else min(n, hi + 4096)
        h, s, e = hash_words(buf[lo:hi], np.zeros(1, np.int64), cls, cut)
        parts.append((h, s + lo, e + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts as (first row, sorted distinct shingle hashes, offsets of each text's set).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A text of fewer than `size` words has its whole
    word sequence as its one shingle; a text without words has none.
    """
    odd = (np.random.default_rng(7).integers(1, 1 << 63, size, dtype=np.uint64) << U(1)) | U(1)
    for first, h, off in text_words(column, NON_SPACE):
        sets = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            w = h[a:b]
            k = min(size, len(w))
            if not k:
                sets.append(w)
                continue
            s = w[: len(w) - k + 1] * odd[0]
            for j in range(1, k):
                s = s + w[j : len(w) - k + 1 + j] * odd[j]
            sets.append(np.unique(mix(s + U(k))))
        yield first, np.concatenate(sets) if sets else h, np.concatenate([[0], np.cumsum([len(s) for s in sets])])
