"""Token counts of whole texts for a byte-level BPE, without making their ids.

A text is cut into pre-tokens, the spans inside which merges stay. Each distinct pre-token of a task goes
through the merges once; its number of tokens is joined to the texts' pre-token occurrences by
hash and summed. The dictionary of a task is bounded and starts anew when full, which costs time only.
Documents never leave their task, so nothing is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.frames import prepare, read
from sediment.llm.kernel import CHUNK, _string_parts, span_hashes

#: Pre-tokens that a worker remembers.
CACHE = 1 << 20
LIMIT = 1024
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Fixed values of the pre-tokenizer's pattern: contractions that stand alone.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def _code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.int32)
    pad = np.append(buf, np.zeros(3, np.uint8)).astype(np.int32) & 0x3F
    for low, high, mask, size in ((0xC0, 0xE0, 0x1F, 2), (0xE0, 0xF0, 0x0F, 3), (0xF0, 0x100, 0x07, 4)):
        k = np.flatnonzero((cp >= low) & (cp < high)) if size == 2 else None
        if k is None:
            k = np.flatnonzero((buf[at] >= low) & (buf[at] < high) if high < 0x100 else buf[at] >= low)
        if len(k):
            value = cp[k] & mask
            for j in range(1, size):
                value = (value << 6) | pad[at[k] + j]
            cp[k] = np.minimum(value, 0x10FFFF)
    return cp, at


def pre_tokens(buf: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start; breaks: where texts begin.

    A pre-token is a contraction, or a run of letters, of numbers or of other visible characters, each with one
    space before it if there is one, or a run of white space; of white space before a visible character the
    last one stands apart, or in front of what follows if it is a space.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    cp, at = _code_points(buf)
    kind = table[cp]
    n = len(cp)
    first = np.zeros(n + 1, bool)  # of a text, and the end
    first[np.searchsorted(at, breaks[breaks < len(buf)])] = True
    first[n] = True
    start = np.empty(n, bool)
    start[0], start[1:] = True, kind[1:] != kind[:-1]
    start |= first[:n]
    # the last white space before a visible character of the same text
    space = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start[last] = True
    glued = np.flatnonzero(last & (cp == 0x20)) + 1
    start[glued] = False
    # contractions: an apostrophe that starts a pre-token, and the letters that follow it
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        done = np.zeros(len(quote), bool)
        for word in CONTRACTIONS:
            ok = ~done
            for j, c in enumerate(word, 1):
                k = np.minimum(quote + j, n - 1)
                ok &= (quote + j < n) & (cp[k] == ord(c)) & ~first[k]
            q = quote[ok]
            done |= ok
            start[q + 1] = False
            after = q + 1 + len(word)
            after = after[after < n]
            start[after] = True
    return at[start]


def _merger(path: str):
    """The merges of a byte-level BPE file as a function from bytes to tokens, and the strings of its special tokens.

    The file writes each byte as a printable character: itself where it is printable, else one from U+0100 on.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes([b]): k for k, b in enumerate([*shown, *hidden])}
    for k, merge in enumerate(spec["model"]["merges"]):
        pair = merge.split(" ") if isinstance(merge, str) else merge
        ranks[bytes(byte_of[c] for c in "".join(pair))] = 256 + k
    core = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece, [t["content"].encode() for t in spec["added_tokens"]]


class Counter:
    """Counts tokens of texts, remembering those of the pre-tokens met so far."""

    def __init__(self, path: str):
        self.merge, self.special = _merger(path)
        self.table = _classes()
        self.keys, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, spans: list[bytes]) -> None:
        got = [len(self.merge(x)) for x in spans]
        keys, got = np.concatenate([self.keys, keys]), np.concatenate([self.tokens, np.array(got, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.tokens = keys[order], got[order]

    def count(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tokens of each text; at: offsets of the texts in buf, which hold no special token."""
        starts = pre_tokens(buf, at[:-1], self.table)
        if not len(starts):
            return np.zeros(len(at) - 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        keys, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self.keys, self.tokens = self.keys[:0], self.tokens[:0]
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            whole = buf.tobytes()
            self._learn(keys[new], [whole[a:z] for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        sums = np.concatenate([[0], np.cumsum(self.tokens[np.searchsorted(self.keys, keys)][which])])
        return np.diff(sums[np.searchsorted(starts, at)])

    def texts(self, column: pa.Array) -> np.ndarray:
        """The tokens of every text of a column."""
        data, off = _string_parts(column)
        rows, row, out = len(off) - 1, 0, []
        while row < rows:
            end = max(int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1, row + 1)
            buf, at = data[int(off[row]) : int(off[end])], off[row : end + 1] - off[row]
            whole = buf.tobytes()
            if any(s in whole for s in self.special):
                out.append(self._with_specials(whole, at))
            else:
                out.append(self.count(buf, at))
            row = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _with_specials(self, whole: bytes, at: np.ndarray) -> np.ndarray:
        """Special tokens' strings count as one token each and part what stands around them."""
        parts, owner, extra = [], [], np.zeros(len(at) - 1, np.int64)
        for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            pieces = [whole[a:z]]
            for s in self.special:
                cut = [p.split(s) for p in pieces]
                extra[i] += sum(len(c) - 1 for c in cut)
                pieces = [x for c in cut for x in c]
            parts += pieces
            owner += [i] * len(pieces)
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        n = self.count(np.frombuffer(b"".join(parts), np.uint8), off)
        return extra + np.bincount(owner, n, minlength=len(extra)).astype(np.int64)


def _count(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            n = counter.texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names if c != "text"] + [pa.array(n)], names=[*(c for c in b.schema.names if c != "text"), column])

    return run


def tokenizer_path() -> str:
    """The public tokenizer file, which every machine has in its own library folder."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs (doc_id, text).

    Counts are those of the library without begin, end or added special tokens; special strings inside a text
    are handled as by its default. A null text counts as empty: 0 and 0; a text of any length is counted as a whole. Rows are counted one by one, so
    repeated rows and ids give equal rows; other columns are left out; an empty table gives none.
    """
    prepare(spark)
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_count(path or tokenizer_path(), "n_tokens"), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
