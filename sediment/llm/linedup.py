"""Repeated-line removal with two Bloom filters.

A first scan fills two filters of line keys: a bit of the first is set by any line, a bit of the second once
a second document sets it again. Both merge by bit operations, so each task fills its own pair and pairs
merge by segment. A key all of whose bits are in the second filter is a suspected repeat; a second scan
sends only those to the shuffle, where documents are counted on the keys themselves. A full filter lets
more lines through to that count and changes no result.

Texts stay where they are: the confirmed repeats, as 128-bit hashes seeded at random, go to the tasks that cut the lines.
If there are more than TOLD of them, only documents that hold a suspected repeat are shuffled to their lists instead.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.frames import Scratch, batch, ddl, prepare, read
from sediment.llm.kernel import U

#: Bits that a key sets.
HASHES = 4
#: A filter has a bit for so many bytes of input, within the bounds; at the upper one a pair is 256 MB in each process.
BYTES_A_BIT, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 30
#: Bytes of filter in one row of the merge.
SEGMENT = 1 << 16
#: Repeated keys that are told to all tasks, 24 bytes each.
TOLD = 1 << 21
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # bytes lower A-Z only


def code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def _keys(text: bytes, least: int) -> set[bytes]:
    """The distinct keys of a text that are long enough to count."""
    found = set()
    for line in text.split(b"\n"):
        if len(line) >= least and code_points(k := line_key(line)) >= least:
            found.add(k)
    return found


def _bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """(keys, HASHES) bit positions, by double hashing."""
    h1, h2 = hashes & U(0xFFFFFFFF), (hashes >> U(32)) | U(1)
    return np.stack([(h1 + U(i) * h2) & U(n_bits - 1) for i in range(HASHES)], axis=1).astype(np.int64)


class Filters:
    """The filter of what was seen and the filter of what was seen again."""

    def __init__(self, n_bits: int):
        self.n_bits, self.once, self.twice = n_bits, np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Each hash counts once for each time it occurs here, so a document gives each of its keys once."""
        at, n = np.unique(_bits(hashes, self.n_bits).ravel(), return_counts=True)
        for bits, target in ((at[n > 1], self.twice), (at[(self.once[at >> 3] >> (at & 7)) & 1 == 1], self.twice), (at, self.once)):
            if len(bits):
                byte, first = np.unique(bits >> 3, return_index=True)
                target[byte] |= np.bitwise_or.reduceat((1 << (bits & 7)).astype(np.uint8), first)


_SEGMENTS = {"segment": pa.int64(), "once": pa.binary(), "twice": pa.binary()}


def _fill(n_bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, held = Filters(n_bits), []
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                if t and len(t) >= least:
                    held += [xxhash.xxh3_64_intdigest(k) for k in _keys(t, least)]
                if len(held) > 1 << 16:
                    filters.add(np.array(held, np.uint64))
                    held = []
        if held:
            filters.add(np.array(held, np.uint64))
        for k in range(0, n_bits // 8, SEGMENT):
            part = filters.once[k : k + SEGMENT]
            if part.any():
                yield batch(_SEGMENTS, segment=[k // SEGMENT], once=[zlib.compress(part.tobytes(), 1)], twice=[zlib.compress(filters.twice[k : k + SEGMENT].tobytes(), 1)])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each segment of rows sorted by segment."""
    last, once, twice = None, None, None
    for b in batches:
        for segment, o, t in zip(*(b.column(c).to_pylist() for c in _SEGMENTS), strict=True):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            if segment != last:
                if last is not None:
                    yield batch(_SEGMENTS, segment=[last], once=[once.tobytes()], twice=[twice.tobytes()])
                last, once, twice = segment, o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if last is not None:
        yield batch(_SEGMENTS, segment=[last], once=[once.tobytes()], twice=[twice.tobytes()])


_SUSPECTS = {"key": pa.binary(), "doc_id": pa.int64()}


def _suspected(twice: np.ndarray, n_bits: int, keys: list[bytes]) -> np.ndarray:
    at = _bits(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), n_bits)
    return ((twice[at >> 3] >> (at & 7)) & 1).all(axis=1)


def _suspects(shared, n_bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t and i is not None and len(t) >= least:
                    for k in _keys(t, least):
                        ids.append(i)
                        keys.append(k)
            if keys:
                keep = np.flatnonzero(_suspected(twice, n_bits, keys)).tolist()
                yield batch(_SUSPECTS, key=[keys[k] for k in keep], doc_id=[ids[k] for k in keep])

    return run


def _flag(shared, n_bits: int, least: int, wanted: bool):
    """The rows that hold a suspected repeat, or those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            keys, at = [], []
            for row, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                for k in _keys(t, least) if t and len(t) >= least else ():
                    keys.append(k)
                    at.append(row)
            has = np.zeros(b.num_rows, bool)
            if keys:
                has[np.array(at)[_suspected(twice, n_bits, keys)]] = True
            yield b.filter(pa.array(has == wanted))

    return run


def _hashed(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [xxhash.xxh3_128_digest(k, seed) for k in b.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), b.column("keeper")], names=["digest", "keeper"])

    return run


class Repeats:
    """Repeated keys by their 128-bit hashes, and the document that keeps each."""

    def __init__(self, seed: int, digests: list[bytes], keepers: np.ndarray):
        self.seed = seed
        halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.high, self.low, self.keeper = halves[order, 0], halves[order, 1], keepers[order]

    def gone(self, keys: list[bytes], docs: np.ndarray) -> np.ndarray:
        """Whether each key is a repeat that its document does not keep."""
        out = np.zeros(len(keys), bool)
        if not len(keys) or not len(self.high):
            return out
        halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, self.seed) for k in keys), np.uint64).reshape(-1, 2)
        at, left = np.searchsorted(self.high, halves[:, 0]), np.arange(len(keys))
        while len(left):  # more than one step only where hashes agree in their first half
            inside = at[left] < len(self.high)
            left = left[inside]
            left = left[self.high[at[left]] == halves[left, 0]]
            hit = left[self.low[at[left]] == halves[left, 1]]
            out[hit] = self.keeper[at[hit]] != docs[hit]
            left = left[self.low[at[left]] != halves[left, 1]]
            at[left] += 1
        return out


def _cut(names: list[str], least: int, shared=None, lists: str | None = None):
    """Texts without the lines that their document loses: by the repeats told to all, or by the list in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = shared.value if shared is not None else None
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            split = [t.split(b"\n") for t in texts]
            gone: list[set[int]] = [set() for _ in texts]
            if repeats is None:
                for row, drop in enumerate(b.column(lists).to_pylist()):
                    if drop:
                        drop = set(drop)
                        gone[row] = {k for k, x in enumerate(split[row]) if len(x) >= least and line_key(x) in drop}
            else:
                keys, at, docs = [], [], []
                for row, i in enumerate(b.column("doc_id").cast(pa.int64()).to_pylist()):
                    if i is None or len(texts[row]) < least:
                        continue
                    for k, x in enumerate(split[row]):
                        if len(x) >= least and len(key := line_key(x)) >= least:
                            keys.append(key)
                            at.append((row, k))
                            docs.append(i)
                for j in np.flatnonzero(repeats.gone(keys, np.array(docs, np.int64))).tolist():
                    gone[at[j][0]].add(at[j][1])
            kept = [b"\n".join([x for k, x in enumerate(lines) if k not in g]) if g else t for t, lines, g in zip(texts, split, gone, strict=True)]
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "_n_lines": pa.array([len(x) for x in split], pa.int64()), "_n_dropped": pa.array([len(g) for g in gone], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    return run


def dedup_lines(spark: SparkSession, docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, told: int = TOLD) -> DataFrame:
    """docs without lines repeated in min_docs documents or more, with _n_lines and _n_dropped added.

    A line's key is the line stripped of `[\\x20\\x09-\\x0D]` with A-Z lower-cased; keys of fewer than min_chars
    code points never go. All lines of a repeated key go except in the largest doc_id that holds it. A null
    text counts as one empty line and comes back empty; a text of any length is cut as a whole. Rows that share a
    doc_id are one document; a row without doc_id is none and keeps its lines. Other columns pass through, whatever
    their names; ones named _n_lines or _n_dropped give way to the new ones. An empty table gives an empty one.
    """
    prepare(spark)
    s = Scratch(spark)
    docs = docs.drop("_n_lines", "_n_dropped").withColumn("text", F.col("text").cast("string"))
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_bits = 1 << (max(LEAST_BITS, min(MOST_BITS, size // BYTES_A_BIT)) - 1).bit_length()
    filled = texts.select("text").mapInArrow(_fill(n_bits, min_chars), ddl(_SEGMENTS))
    merged = s.save(filled.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, ddl(_SEGMENTS)))
    twice = bytearray(n_bits // 8)
    for row in merged.select("segment", "twice").toLocalIterator():  # at most MOST_BITS in all
        twice[row.segment * SEGMENT : row.segment * SEGMENT + len(row.twice)] = row.twice
    shared = spark.sparkContext.broadcast(bytes(twice))
    suspects = s.save(texts.mapInArrow(_suspects(shared, n_bits, min_chars), ddl(_SUSPECTS)))
    counts = suspects.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    repeats = s.save(counts.where(F.col("n") >= min_docs).select("key", "keeper"))
    schema = docs.withColumns({"_n_lines": F.lit(0).cast("bigint"), "_n_dropped": F.lit(0).cast("bigint")}).schema
    if repeats.count() <= told:
        seed = int.from_bytes(os.urandom(8), "little")
        got = repeats.mapInArrow(_hashed(seed), "digest binary, keeper bigint").toArrow()
        known = spark.sparkContext.broadcast(Repeats(seed, got.column("digest").to_pylist(), got.column("keeper").to_numpy()))
        s.sweep()
        return docs.mapInArrow(_cut(schema.names, min_chars, known), schema)
    lost = suspects.join(repeats, "key").where("doc_id != keeper")
    tag = uuid.uuid4().hex  # names that no column of docs has
    drops = s.save(lost.groupBy(F.col("doc_id").alias(f"id{tag}")).agg(F.collect_set("key").alias(f"drop{tag}")))
    s.sweep(drops)
    # only rows that hold a suspected repeat are shuffled
    maybe = docs.mapInArrow(_flag(shared, n_bits, min_chars, True), docs.schema)
    joined = maybe.join(drops, maybe.doc_id.cast("bigint") == drops[f"id{tag}"], "left").drop(f"id{tag}")
    rest = docs.mapInArrow(_flag(shared, n_bits, min_chars, False), docs.schema).withColumn(f"drop{tag}", F.lit(None).cast("array<binary>"))
    both = joined.select(*rest.columns).union(rest)
    return both.mapInArrow(_cut(schema.names, min_chars, lists=f"drop{tag}"), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(spark, docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
