"""The two binary formats as Spark data sources, read by position.

`spark.read.format("sediment_run").load(folder)` and `"sediment_log"`, once `register(spark)` has been called. A run file is split by
its index into parts of at most PART_BYTES, each read from its own place; of a log file, whose records have no index, each part of
the file system's bytes is read in turn by one task. So no file has to fit in memory. Paths are those that Arrow's file systems reach
(local, s3, gs, hdfs); `formats.read_runs` and `read_logs` go through Spark's own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sediment.sources.formats import LOG_SCHEMA, RUN_SCHEMA, FormatError, decode_entry, decode_log
from sediment.sources.shared import ship

#: Bytes of frames that one task reads of a run file, and that any task reads at once.
PART_BYTES, CHUNK = 64 << 20, 4 << 20


def _open(uri: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return files, path


def _paths(uri: str) -> list[str]:
    """The files of a path, ascending; hidden and unfinished ones are left out."""
    from pyarrow import fs

    files, path = _open(uri)
    if files.get_file_info(path).type == fs.FileType.File:
        return [path]
    found = files.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and not f.base_name.endswith(".part"))


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    end: int


def run_parts(uri: str, path: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of parts of a run file's frames that hold whole entries, from its header and index alone."""
    files, _ = _open(uri)
    with files.open_input_file(path) as f:
        total = f.size()
        try:
            (filled,) = struct.unpack("<q", f.read_at(8, 0))
            (length,) = struct.unpack("<q", f.read_at(8, 8 + filled))
            first, at, out, last = 16 + filled + length, 16 + filled, [], None
            (count,) = struct.unpack("<i", f.read_at(4, at))
            at += 4
            # the index is read a chunk at a time: of each entry, only its offset matters here
            held, held_at = b"", at
            for _ in range(count):
                if at + 4 - held_at > len(held):
                    held, held_at = f.read_at(CHUNK, at), at
                (n,) = struct.unpack_from("<i", held, at - held_at)
                if at + 12 + n - held_at > len(held):
                    held, held_at = f.read_at(max(CHUNK, 12 + n), at), at
                (offset,) = struct.unpack_from("<q", held, at - held_at + 4 + n)
                if last is None or offset - last >= size:
                    out.append(first + offset)
                    last = offset
                at += 12 + n
        except struct.error as e:
            raise FormatError(f"{path}: {e}") from e
    return list(zip(out, [*out[1:], total], strict=True)) if out else []


def _run_rows(uri: str, part: _Part) -> Iterator[tuple]:
    files, _ = _open(uri)
    with files.open_input_file(part.path) as f:
        at, held, held_at = part.start, b"", part.start
        while at < part.end:
            if at + 8 - held_at > len(held):
                held, held_at = f.read_at(min(CHUNK, part.end - at), at), at
            if len(held) - (at - held_at) < 8:
                raise FormatError(f"{part.path}: an entry is cut short")
            (n,) = struct.unpack_from("<q", held, at - held_at)
            if n <= 0 or at + 8 + n > part.end:
                raise FormatError(f"{part.path}: an entry is cut short")
            if at + 8 + n - held_at > len(held):
                held, held_at = f.read_at(min(max(CHUNK, 8 + n), part.end - at), at), at
            e = decode_entry(held[at + 8 - held_at : at + 8 + n - held_at])
            yield part.path, e.key, e.ts, e.op, e.value
            at += 8 + n


def _log_rows(uri: str, part: _Part) -> Iterator[tuple]:
    """The records up to the first damaged one; a record longer than a chunk is read again with more bytes."""
    files, _ = _open(uri)
    with files.open_input_file(part.path) as f:
        at, want = 0, CHUNK
        while at < part.end:
            held = f.read_at(min(want, part.end - at), at)
            rows, left = decode_log(held)
            for r in rows:
                yield part.path, r.lsn, r.entry.op, r.entry.key, r.entry.value, r.entry.ts, r.crc, r.is_checkpoint
            at += len(held) - left
            if not rows:
                size = struct.unpack_from("<i", held)[0] if len(held) >= 4 else 0
                if size + 4 <= want or at + 4 + size > part.end:
                    return
                want = size + 4
            else:
                want = CHUNK


class _Reader(DataSourceReader):
    def __init__(self, uri: str, run: bool, size: int):
        self.uri, self.run, self.size = uri, run, size

    def partitions(self) -> list[_Part]:
        files, _ = _open(self.uri)
        if self.run:
            return [_Part(p, a, z) for p in _paths(self.uri) for a, z in run_parts(self.uri, p, self.size)] or [_Part("", 0, 0)]
        return [_Part(p, 0, files.get_file_info(p).size) for p in _paths(self.uri)] or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.path:
            return iter(())
        return (_run_rows if self.run else _log_rows)(self.uri, partition)


class RunSource(DataSource):
    """Entries of run files: (path, key, ts, op, value). Option part_bytes: frames that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "sediment_run"

    def schema(self) -> str:
        return RUN_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], True, int(self.options.get("part_bytes", PART_BYTES)))


class LogSource(DataSource):
    """Records of log files, each up to its first damaged one: (path, lsn, op, key, value, ts, crc, is_checkpoint)."""

    @classmethod
    def name(cls) -> str:
        return "sediment_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], False, 0)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RunSource)
    spark.dataSource.register(LogSource)
