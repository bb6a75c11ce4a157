"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie, with byte fallback.

A text gets one space in front, spaces become the whitespace marker, and of all ways to cut it into pieces
the one with the highest sum of log scores is taken. A character that is no piece by itself may stand as
unknown, at a penalty, and is then written as byte pieces. Decoding joins the pieces, turns the marker
into spaces and drops the one in front.

The best cut decomposes wherever two neighbouring bytes never stand next to each other inside a piece. Texts
are split there into units, mostly words with their marker, and each distinct unit goes through the
Viterbi search once for as long as a worker's cache holds it. The search runs over many units at a time.

The public vocabulary file carries ranks, not probabilities; a piece of rank r gets the log of the Zipf
probability 1 / (r + ZIPF), normalised over all pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sediment.llm.frames import ddl, prepare, read
from sediment.llm.kernel import CHUNK, _string_parts, span_hashes, take_ranges

ZIPF = 2.7
#: Below the lowest log score, for a character that is no piece; the library's value.
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers, and those the search takes at once.
CACHE_UNITS, SEARCH_UNITS = 1 << 20, 1 << 14
#: Units as long as this go through the search one by one.
LONG_UNIT = 96
MARKER = "▁".encode()


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: from state s, byte c leads to t = base[s] + c if check[t] == s.

    value[t] is the index of the key that ends in state t, or -1. State 0 is the root.
    """
    children: list[dict[int, int]] = [{}]
    ends = {}
    for k, key in enumerate(keys):
        node = 0
        for c in key:
            nxt = children[node].get(c)
            if nxt is None:
                nxt = children[node][c] = len(children)
                children.append({})
            node = nxt
        ends[node] = k
    size = 2 * len(children) + 512
    base, check, value = [0] * size, [-1] * size, [-1] * size
    used = bytearray(size)
    used[0] = 1
    low, queue = 1, deque([(0, 0)])
    while queue:
        node, state = queue.popleft()
        if node in ends:
            value[state] = ends[node]
        if not children[node]:
            continue
        codes = sorted(children[node])
        place, misses = low, 0
        while True:
            place = used.find(0, place)
            b = place - codes[0]
            if place + 512 > len(used):
                grow = len(used)
                used.extend(bytes(grow))
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
            if b > 0 and not any(used[b + c] for c in codes):
                break
            place += 1
            misses += 1
        if misses > 64:
            low = place
        low = max(low, used.find(0, low))
        base[state] = b
        for c in codes:
            used[b + c] = 1
            check[b + c] = state
            queue.append((children[node][c], b + c))
    top = len(used) - used[::-1].index(1) + 256
    pad = [0] * max(0, top - len(base))
    return tuple(np.array((x + p)[:top], np.int32) for x, p in ((base, pad), (check, [-1] * len(pad)), (value, [-1] * len(pad))))


@dataclass
class Vocabulary:
    """Pieces with the marker as a space, their ids and log scores, and the ids of the byte pieces."""

    pieces: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self):
        self.base, self.check, self.value = double_array(self.pieces)
        self.unknown = np.float32(self.scores.min() - UNKNOWN_PENALTY)
        self.pair = np.zeros((256, 256), bool)
        for p in self.pieces:
            if len(p) > 1:
                b = np.frombuffer(p, np.uint8)
                self.pair[b[:-1], b[1:]] = True
        top = int(max(self.ids.max(), self.byte_ids.max())) + 1
        text = [b""] * top
        for i, p in zip(self.ids.tolist(), self.pieces, strict=True):
            text[i] = p
        for c, i in enumerate(self.byte_ids.tolist()):
            text[i] = bytes([c])
        self.piece_len = np.array([len(t) for t in text])
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.is_byte = np.zeros(top, bool)
        self.is_byte[self.byte_ids] = True


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file, in rank order, with Zipf log scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, byte_ids = [], np.zeros(256, np.int64)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain.append((i, piece.encode().replace(MARKER, b" ")))
    log = -np.log(np.arange(len(plain)) + ZIPF)
    log -= np.log(np.exp(log).sum())
    return Vocabulary([p for _, p in plain], np.array([i for i, _ in plain]), log.astype(np.float32), byte_ids)


def char_lengths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that a leading byte opens."""
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def search(v: Vocabulary, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi over many units at once: (ids of all units' pieces, counts). A tie keeps the earlier start."""
    n, lengths = len(starts), ends - starts
    width = int(lengths.max())
    text = np.zeros((n, width + 1), np.uint8)
    text[np.repeat(np.arange(n), lengths), take_ranges(np.zeros(n, np.int64), lengths)] = buf[take_ranges(starts, lengths)]
    best = np.full((n, width + 1), -np.inf, np.float32)
    best[:, 0] = 0
    came, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
    for i in range(width):
        rows = np.flatnonzero((best[:, i] > -np.inf) & (lengths > i))
        if not len(rows):
            continue
        one = char_lengths(text[rows, i])
        single = np.zeros(n, bool)
        live, state, j = rows, np.zeros(len(rows), np.int64), i
        alone = i + one
        while len(live):
            to = v.base[state] + text[live, j]
            ok = (v.check[to] == state) & (j < lengths[live])
            live, state, alone = live[ok], to[ok], alone[ok]
            j += 1
            k = v.value[state]
            end = k >= 0
            if end.any():
                r, k = live[end], k[end]
                single[r[alone[end] == j]] = True
                score = best[r, i] + v.scores[k]
                better = score > best[r, j]
                r = r[better]
                best[r, j], came[r, j], piece[r, j] = score[better], i, k[better]
        lone = ~single[rows]
        if lone.any():
            r, j = rows[lone], np.minimum(i + one[lone], lengths[rows[lone]])
            score = best[r, i] + v.unknown
            better = score > best[r, j]
            r, j = r[better], j[better]
            best[r, j], came[r, j], piece[r, j] = score[better], i, -1
    # back from the ends, pieces last first; an unknown character gives its bytes
    at, rows, found = lengths.copy(), np.arange(n), []
    while len(rows):
        j = at[rows]
        i, k = came[rows, j], piece[rows, j]
        known = k >= 0
        found.append((rows[known], i[known], v.ids[k[known]]))
        for r, a, z in zip(rows[~known].tolist(), i[~known].tolist(), j[~known].tolist(), strict=True):
            found.append((np.full(z - a, r), np.arange(a, z), v.byte_ids[text[r, a:z]]))
        at[rows] = i
        rows = rows[i > 0]
    row, place, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, row))
    return ids[order], np.bincount(row, minlength=n)


def search_long(v: Vocabulary, unit: bytes) -> list[int]:
    """The same search for one long unit."""
    base, check, value, scores = _lists(v)
    n, low = len(unit), float("-inf")
    best, came = [low] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = np.float32(0)
    for i in range(n):
        if best[i] == low or (unit[i] & 0xC0) == 0x80:
            continue
        size = 1 + (unit[i] >= 0xC0) + (unit[i] >= 0xE0) + (unit[i] >= 0xF0)
        state, j, single = 0, i, False
        while j < n:
            to = base[state] + unit[j]
            if check[to] != state:
                break
            state, j = to, j + 1
            k = value[state]
            if k >= 0:
                single |= j == i + size
                score = best[i] + scores[k]
                if score > best[j]:
                    best[j], came[j] = score, (i, k)
        if not single:
            j = min(n, i + size)
            score = best[i] + v.unknown
            if score > best[j]:
                best[j], came[j] = score, (i, -1)
    out, j = [], n
    while j:
        i, k = came[j]
        out.append([int(v.ids[k])] if k >= 0 else v.byte_ids[list(unit[i:j])].tolist())
        j = i
    return [x for part in reversed(out) for x in part]


_as_lists: dict[int, tuple] = {}


def _lists(v: Vocabulary) -> tuple:
    if id(v) not in _as_lists:
        _as_lists.clear()
        _as_lists[id(v)] = (v.base.tolist(), v.check.tolist(), v.value.tolist(), list(v.scores))
    return _as_lists[id(v)]


class Encoder:
    """Encodes texts, remembering the pieces of the units met so far."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, buf: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Searches new units, given with their hashes."""
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] < LONG_UNIT]
        ids, counts, who = [], [], []
        for k in range(0, len(short), SEARCH_UNITS):
            part = short[k : k + SEARCH_UNITS]
            got, n = search(self.v, buf, starts[part], ends[part])
            ids.append(got)
            counts.append(n)
            who.append(part)
        for u in order[len(short) :].tolist():
            got = np.array(search_long(self.v, buf[starts[u] : ends[u]].tobytes()))
            ids.append(got)
            counts.append(np.array([len(got)]))
            who.append(np.array([u]))
        ids, counts, who = (np.concatenate(x).astype(np.int64) for x in (ids, counts, who))
        slots = len(self.at) + np.arange(len(who))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        keys, slots = np.concatenate([self.keys, keys[who]]), np.concatenate([self.slot, slots])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slots[order]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of texts as (first row, ids, offsets of each text's ids, bytes with the space in front, their offsets)."""
        data, off = _string_parts(column)
        rows, row = len(off) - 1, 0
        while row < rows:
            end = max(int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1, row + 1)
            raw = data[int(off[row]) : int(off[end])]
            lens = np.diff(off[row : end + 1])
            if MARKER in (whole := raw.tobytes()):
                parts = [whole[a:z].replace(MARKER, b" ") for a, z in zip((off[row:end] - off[row]).tolist(), (off[row + 1 : end + 1] - off[row]).tolist(), strict=True)]
                raw, lens = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
            some = (lens > 0).astype(np.int64)  # an empty text has no pieces, not even the space
            at = np.concatenate([[0], np.cumsum(lens + some)])
            buf = np.full(int(at[-1]), 0x20, np.uint8)
            buf[take_ranges(at[:-1] + some, lens)] = raw
            yield row, *self._pieces(buf, at), buf, at
            row = end

    def _pieces(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        cut = np.empty(len(buf), bool)
        cut[0], cut[1:] = True, ~self.v.pair[buf[:-1], buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
        cut[at[:-1][at[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        hashes = span_hashes(buf, starts, ends)
        keys, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_UNITS:
            self._forget()
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            self._learn(buf, keys[new], starts[first[new]], ends[first[new]])
        slot = self.slot[np.searchsorted(self.keys, keys)][unit]
        n = self.count[slot]
        sums = np.concatenate([[0], np.cumsum(n)])
        return self.ids[take_ranges(self.at[slot], n)], sums[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces, marker as space, the space in front still there."""
        v = self.v
        return v.piece_bytes[take_ranges(v.piece_at[ids], v.piece_len[ids])]


_OUT = ["n_pieces", "n_byte_pieces", "piece_ids", "round_trip"]
_DDL = "n_pieces bigint, n_byte_pieces bigint, piece_ids array<int>, round_trip boolean"


def _encode(shared, names: list[str], replace_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for first, ids, off, buf, at in encoder.encode(b.column("text").cast(pa.string())):
                rows = len(off) - 1
                back = encoder.decode(ids)
                there = np.concatenate([[0], np.cumsum(encoder.v.piece_len[ids])])[off]
                same = len(back) == len(buf) and np.array_equal(there, at)
                wrong = np.concatenate([[0], np.cumsum(back != buf)]) if same else None
                part = b.slice(first, rows)
                new = {
                    "n_pieces": pa.array(np.diff(off)),
                    "n_byte_pieces": pa.array(np.diff(np.concatenate([[0], np.cumsum(encoder.v.is_byte[ids])])[off])),
                    "piece_ids": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)),
                    "round_trip": pa.array(wrong[at[1:]] == wrong[at[:-1]] if same else [back[there[k] : there[k + 1]].tobytes() == buf[at[k] : at[k + 1]].tobytes() for k in range(rows)]),
                }
                if replace_text:
                    new["text"] = pa.array([back[a + 1 : z].tobytes() for a, z in zip(there[:-1].tolist(), there[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names=names)

    return run


def model_path() -> str:
    """The public vocabulary file, which every machine has in its own library folder."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None, *, columns: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The given columns of docs with n_pieces, n_byte_pieces, piece_ids and round_trip added.

    round_trip: decoding the ids gives the text back, U+2581 counting as a space. With decoded, the text column
    is what decoding gave. A null or empty text has no pieces. Rows are encoded one by one, so repeated
    rows give equal results; a column of docs named as a new one gives way to it, others pass through whatever their
    names. A text of any length is encoded as a whole; an empty table gives an empty one.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(path or model_path()))
    kept = [c for c in (columns or docs.columns) if c not in _OUT]
    source = docs.select(*dict.fromkeys([*kept, "text"]))
    schema = source.select(*kept).schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return source.mapInArrow(_encode(shared, [*kept, *_OUT], decoded), f"{types}, {_DDL}")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, read(spark, sf_dir, "documents"), columns=["doc_id"])
