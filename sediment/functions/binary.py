"""Bytes of log and run entries as column expressions: sizes, little-endian numbers, frames and checksums.

Fixed values, in bytes: an entry carries 8 of time, 1 of command, 4 of key length; a put 4 more of value
length; a log record 8 of LSN, 4 of length, 4 of CRC, 1 of checkpoint flag; frames are prefixed by 8 (run)
or 4 (log); a run file opens with 1,000,024 bytes of filter and lengths and an index of 4 + sum(12 + key).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_HEADER, INDEX_HEADER = 1_000_024, 4
COMMANDS = {"PUT": 0, "TOMBSTONE": 1, "WRITE_SST": 2}


def little_endian(x: Column, size: int) -> Column:
    """The lowest `size` bytes of an integer, lowest first."""
    digits = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def key_bytes(key: Column) -> Column:
    return F.octet_length(key).cast("bigint")


def value_bytes(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def run_frame_size(op: Column, key: Column, value: Column) -> Column:
    """Bytes of an entry's frame in a run: 8 + 17 + K + V for a put, 8 + 13 + K for a tombstone."""
    return key_bytes(key) + F.when(op == "PUT", F.lit(25) + value_bytes(value)).otherwise(F.lit(21))


def log_frame_size(key: Column, value: Column) -> Column:
    """Bytes of a record's frame in the log: 4 + 17 + 17 + K + V."""
    return F.lit(38) + key_bytes(key) + value_bytes(value)


def log_entry(ts: Column, op: Column, key: Column, value: Column) -> Column:
    """A log entry: time, command, key and value with their lengths; an absent value has length 0."""
    code = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])[op]
    v = F.coalesce(value.cast("binary"), F.unhex(F.lit("")))
    return F.concat(
        little_endian(ts, 8), little_endian(code, 1), little_endian(key_bytes(key), 4), key.cast("binary"),
        little_endian(F.octet_length(v), 4), v,
    )


def record_crc(data: Column, lsn: Column) -> Column:
    """CRC32 of the entry's bytes and the lowest byte of its LSN."""
    return F.crc32(F.concat(data, little_endian(lsn, 1)))


def log_frame(data: Column, lsn: Column, checkpoint: Column) -> Column:
    """A framed log record: size, then LSN, length, entry, CRC and checkpoint flag."""
    body = F.concat(little_endian(lsn, 8), little_endian(F.octet_length(data), 4), data, little_endian(record_crc(data, lsn), 4), little_endian(checkpoint.cast("int"), 1))
    return F.concat(little_endian(F.octet_length(body), 4), body)
