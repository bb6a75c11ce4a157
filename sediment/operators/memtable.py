"""Sizes of in-memory tables, and the exact rotation that they cause."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.binary import value_bytes
from sediment.sources.shared import ship


def entry_size() -> Column:
    """What a key's newest entry adds to its table: characters of the key and bytes of the value."""
    return F.length("key").cast("bigint") + value_bytes(F.col("value"))


def sizes(winners: DataFrame, by: str = "run") -> DataFrame:
    """(by, keys, bytes) of tables given by their newest entries."""
    return winners.groupBy(by).agg(F.count("*").alias("keys"), F.sum(entry_size()).alias("bytes"))


def _rotate(limit: int):
    schema = pa.schema([("flush", pa.int64()), ("first_seq", pa.int64()), ("last_seq", pa.int64()), ("entries", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, int] = {}
        size, first, last, done, out = 0, None, None, 0, []
        for b in batches:
            for seq, key, weight in zip(*(b.column(c).to_pylist() for c in ("seq", "key", "weight")), strict=True):
                first = seq if first is None else first
                old = table.get(key)
                size += weight + (len(key) if old is None else -old)
                table[key], last = weight, seq
                if size > limit:
                    out.append((done, first, last, len(table), size))
                    table, size, first, done = {}, 0, None, done + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if table:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (done, first, last, len(table), size)], schema=schema)

    return run


def rotations(log: DataFrame, limit: int) -> DataFrame:
    """(flush, first_seq, last_seq, entries, bytes): tables rotated once they hold more than `limit` bytes.

    Where a table ends depends on every overwrite since the last one ended, so the fold takes the log in order
    in one task, which holds one table; the production path bounds batches by their number of operations.
    """
    ship(log.sparkSession)
    weights = log.select("seq", "key", value_bytes(F.col("value")).alias("weight"))
    return weights.coalesce(1).sortWithinPartitions("seq").mapInArrow(_rotate(limit), "flush bigint, first_seq bigint, last_seq bigint, entries bigint, bytes bigint")
