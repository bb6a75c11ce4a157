"""The two binary formats, run files and log files: bytes in memory, and readers and writers of many files.

Fixed values: all numbers are little-endian. Entry: i64 time, u8 command, i32 key length, key, and for a put
i32 value length, value; a log entry always has a value, of length 0 if absent. Run file: i64 filter
length, filter (i64 slots, a byte each), i64 index length, index (i32 count, then i32 key length, key, i64
offset each), then frames of i64 size and entry. Log frame: i32 size, then i64 LSN, i32 entry length,
entry, u32 CRC of the entry and the low byte of the LSN, u8 checkpoint flag.

Files are read with Spark's binary reader, so any file system that Spark knows will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sediment.functions.binary import COMMANDS
from sediment.functions.slots import SLOTS, slots
from sediment.sources.shared import ship

NAMES = {v: k for k, v in COMMANDS.items()}
RUN_SCHEMA = "path string, key string, ts bigint, op string, value binary"
LOG_SCHEMA = "path string, lsn bigint, op string, key string, value binary, ts bigint, crc bigint, is_checkpoint boolean"


class FormatError(ValueError):
    """Bytes that are not what the format says."""


@dataclass(frozen=True)
class Entry:
    key: str
    op: str
    value: bytes | None = None
    ts: int = 0


@dataclass(frozen=True)
class Record:
    lsn: int
    entry: Entry
    is_checkpoint: bool = False
    crc: int | None = None


def encode_entry(e: Entry, *, log: bool = False) -> bytes:
    key = e.key.encode()
    head = struct.pack("<qBi", e.ts, COMMANDS[e.op], len(key)) + key
    if log or e.op == "PUT":
        value = e.value or b""
        head += struct.pack("<i", len(value)) + value
    return head


def decode_entry(data: bytes, *, log: bool = False) -> Entry:
    """Of a log entry without value bytes, a put has the empty value and any other command none."""
    try:
        ts, code, n = struct.unpack_from("<qBi", data)
        key, at = data[13 : 13 + n].decode(), 13 + n
        op, value = NAMES[code], None
        if log or op == "PUT":
            (size,) = struct.unpack_from("<i", data, at)
            value = data[at + 4 : at + 4 + size]
            if size < 0 or len(value) != size:
                raise FormatError("a value is cut short")
            value = None if op != "PUT" else value
        return Entry(key, op, value, ts)
    except (struct.error, KeyError, UnicodeDecodeError) as e:
        raise FormatError(str(e)) from e


def crc(data: bytes, lsn: int) -> int:
    return zlib.crc32(data + bytes([lsn & 0xFF]))


def encode_record(r: Record) -> bytes:
    data = encode_entry(r.entry, log=True)
    body = struct.pack("<qi", r.lsn, len(data)) + data + struct.pack("<IB", crc(data, r.lsn), r.is_checkpoint)
    return struct.pack("<i", len(body)) + body


def decode_log(data: bytes) -> tuple[list[Record], int]:
    """(records, bytes left): reading stops at the first record that is cut short or fails its checksum."""
    out, at = [], 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<i", data, at)
        body = data[at + 4 : at + 4 + size]
        if size < 17 or len(body) != size:
            break
        lsn, n = struct.unpack_from("<qi", body)
        entry = body[12 : 12 + n]
        if n < 0 or len(body) != 17 + n:
            break
        check, flag = struct.unpack_from("<IB", body, 12 + n)
        if crc(entry, lsn) != check:
            break
        try:
            out.append(Record(lsn, decode_entry(entry, log=True), bool(flag), check))
        except FormatError:
            break
        at += 4 + size
    return out, len(data) - at


def encode_run(entries: Iterable[Entry]) -> bytes:
    """A run file of entries in key order."""
    entries = list(entries)
    frames, index, at = [], [struct.pack("<i", len(entries))], 0
    for e in entries:
        body, key = encode_entry(e), e.key.encode()
        frames.append(struct.pack("<q", len(body)) + body)
        index.append(struct.pack("<i", len(key)) + key + struct.pack("<q", at))
        at += len(frames[-1])
    filled = np.zeros(SLOTS, np.uint8)
    filled[slots([e.key.encode() for e in entries]).ravel()] = 1
    packed = b"".join(index)
    return struct.pack("<qq", 8 + SLOTS, SLOTS) + filled.tobytes() + struct.pack("<q", len(packed)) + packed + b"".join(frames)


def decode_filter(data: bytes) -> np.ndarray:
    """The set slots of a run file's filter, ascending."""
    try:
        size, n = struct.unpack_from("<qq", data)
    except struct.error as e:
        raise FormatError(str(e)) from e
    if size != 8 + n or n < 0 or len(data) < 16 + n:
        raise FormatError("a filter is cut short")
    return np.flatnonzero(np.frombuffer(data, np.uint8, n, 16))


def decode_run(data: bytes) -> list[Entry]:
    """All entries of a run file, in file order."""
    try:
        (size,) = struct.unpack_from("<q", data)
        (index,) = struct.unpack_from("<q", data, 8 + size)
        at, out = 16 + size + index, []
        while at < len(data):
            (n,) = struct.unpack_from("<q", data, at)
            if n <= 0 or at + 8 + n > len(data):
                raise FormatError("an entry is cut short")
            out.append(decode_entry(data[at + 8 : at + 8 + n]))
            at += 8 + n
        return out
    except struct.error as e:
        raise FormatError(str(e)) from e


def run_index(data: bytes) -> tuple[list[tuple[str, int]], int]:
    """((key, offset) in key order, place of the first frame) of a run file."""
    (size,) = struct.unpack_from("<q", data)
    (length,) = struct.unpack_from("<q", data, 8 + size)
    at = 16 + size
    (count,) = struct.unpack_from("<i", data, at)
    out, k = [], at + 4
    for _ in range(count):
        (n,) = struct.unpack_from("<i", data, k)
        key = data[k + 4 : k + 4 + n].decode()
        (offset,) = struct.unpack_from("<q", data, k + 4 + n)
        out.append((key, offset))
        k += 12 + n
    return out, at + length


def get_from_run(data: bytes, key: str) -> Entry | None:
    """A key's entry in a run file: filter, then the index's greatest key up to it, then its frame."""
    import bisect

    if not all(data[16 + s] for s in slots([key.encode()])[0].tolist()):
        return None
    index, first = run_index(data)
    k = bisect.bisect_right(index, key, key=lambda x: x[0]) - 1
    if k < 0 or index[k][0] != key:
        return None
    at = first + index[k][1]
    (n,) = struct.unpack_from("<q", data, at)
    return decode_entry(data[at + 8 : at + 8 + n])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            rows = decode_run(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), pa.array([e.key for e in rows], pa.string()), pa.array([e.ts for e in rows], pa.int64()), pa.array([e.op for e in rows], pa.string()), pa.array([e.value for e in rows], pa.binary())],
                names=["path", "key", "ts", "op", "value"],
            )


def _logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            rows, _ = decode_log(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(rows), pa.string()), pa.array([r.lsn for r in rows], pa.int64()), pa.array([r.entry.op for r in rows], pa.string()),
                    pa.array([r.entry.key for r in rows], pa.string()), pa.array([r.entry.value for r in rows], pa.binary()), pa.array([r.entry.ts for r in rows], pa.int64()),
                    pa.array([r.crc for r in rows], pa.int64()), pa.array([r.is_checkpoint for r in rows], pa.bool_()),
                ],
                names=["path", "lsn", "op", "key", "value", "ts", "crc", "is_checkpoint"],
            )


def _health(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [decode_log(x) for x in b.column("content").to_pylist()]
        damaged = [left > 0 for _, left in got]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([len(r) for r, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64()), pa.array(damaged, pa.bool_())], names=["path", "records", "bytes_left", "damaged"])


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The entries of all run files under a path; a damaged file is an error. A file must fit in a task: larger ones are read by position, see datasource."""
    return _files(spark, path).mapInArrow(_runs, RUN_SCHEMA)


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of all log files under a path, each up to its first damaged record; see log_health."""
    return _files(spark, path).mapInArrow(_logs, LOG_SCHEMA)


def log_health(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, records, bytes_left, damaged) of all log files under a path: what reading gives, and what it leaves unread."""
    return _files(spark, path).mapInArrow(_health, "path string, records bigint, bytes_left bigint, damaged boolean")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        held: list[Entry] = []
        now, done = None, []

        def flush() -> None:
            data = encode_run(held)
            name = f"{base}/sstable_0_{now}"
            with files.open_output_stream(name + ".part") as f:
                f.write(data)
            files.move(name + ".part", name)  # a repeated task replaces its file whole
            done.append((now, name, len(data)))

        for b in batches:
            for row in b.to_pylist():
                if row["run"] != now:
                    if held:
                        flush()
                    now, held = row["run"], []
                value = row["value"]
                held.append(Entry(row["key"], row["op"], value.encode() if isinstance(value, str) else value, row["seq"]))
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["run", "path", "bytes"])

    return run


def write_runs(entries: DataFrame, folder: str) -> DataFrame:
    """Writes one run file for each run of (run, key, seq, op, value) into a shared folder: (run, path, bytes).

    A task holds one run at a time, which the size of runs bounds. The frame is lazy: the files are there once
    its rows have been read.
    """
    from pyarrow import fs

    ship(entries.sparkSession)
    uri = folder if "://" in folder else f"file://{folder}"
    files, base = fs.FileSystem.from_uri(uri)
    files.create_dir(base, recursive=True)
    return entries.repartition("run").sortWithinPartitions("run", "key").mapInArrow(_write(uri), "run bigint, path string, bytes bigint")
