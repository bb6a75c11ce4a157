"""The write-ahead log: LSNs, frames, checksums, segments, checkpoints, retention and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions import binary
from sediment.functions.prefix import running_sum
from sediment.operators import resolve

SEGMENT_BYTES, KEPT_SEGMENTS = 128_000, 3
#: Operations between the end of a run and its checkpoint record, written by then by a newer table.
CHECKPOINT_LAG = 120


def with_checkpoints(log: DataFrame, ops: int, lag: int = CHECKPOINT_LAG) -> DataFrame:
    """(lsn, op, key, value, seq, is_checkpoint, covered_lsn): the log with a record for each flushed run.

    The record of run k follows `lag` operations after the run's last; it covers LSNs up to that last one.
    LSNs count operations and the records before them, so they need no global sort.
    """
    before = F.greatest(F.lit(0), F.floor((F.col("seq") - 1 - lag) / ops))
    rows = log.select((F.col("seq") + before).alias("lsn"), "op", "key", "value", "seq", F.lit(False).alias("is_checkpoint"), F.lit(None).cast("bigint").alias("covered_lsn"))
    at_end = log.where((F.col("seq") > ops) & ((F.col("seq") - lag) % ops == 0))
    k = F.floor((F.col("seq") - lag) / ops)
    covered = k * ops + F.greatest(F.lit(0), F.floor((k * ops - 1 - lag) / F.lit(ops)))
    marks = at_end.select((F.col("seq") + k).alias("lsn"), F.lit("WRITE_SST").alias("op"), F.concat(F.lit("sstable_0_"), k.cast("string")).alias("key"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("seq"), F.lit(True).alias("is_checkpoint"), covered.alias("covered_lsn"))
    return rows.union(marks)


def frames(records: DataFrame) -> DataFrame:
    """records with frame_bytes, the size of each framed record."""
    return records.withColumn("frame_bytes", binary.log_frame_size(F.col("key"), F.col("value")))


def segmented(records: DataFrame, limit: int = SEGMENT_BYTES) -> DataFrame:
    """records with frame_bytes and segment: how often the bytes before fill a segment."""
    out = running_sum(frames(records), "lsn", F.col("frame_bytes"), "bytes_before")
    return out.withColumn("segment", F.floor(F.col("bytes_before") / limit).cast("bigint")).drop("bytes_before")


def segments(segmented: DataFrame) -> DataFrame:
    """(segment, records, bytes, first_lsn, last_lsn)."""
    return segmented.groupBy("segment").agg(F.count("*").alias("records"), F.sum("frame_bytes").alias("bytes"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def retained(segments: DataFrame, keep: int = KEPT_SEGMENTS) -> DataFrame:
    """The newest `keep` segments, of one row each."""
    return segments.orderBy(F.desc("segment")).limit(keep)


def checksums(records: DataFrame) -> DataFrame:
    """(lsn, crc) over each record's entry and the low byte of its LSN; the time is 0, so that results repeat."""
    data = binary.log_entry(F.lit(0), F.col("op"), F.col("key"), F.col("value"))
    return records.select("lsn", binary.record_crc(data, F.col("lsn")).alias("crc"))


def read_all(segmented: DataFrame) -> DataFrame:
    """Records of the newest segment from its last checkpoint on, that one included; none without a checkpoint."""
    newest = segmented.agg(F.max("segment").alias("segment"))
    rows = segmented.join(F.broadcast(newest), "segment")
    mark = rows.where("is_checkpoint").agg(F.max("lsn").alias("mark"))
    return rows.join(F.broadcast(mark), F.col("lsn") >= F.col("mark")).drop("mark")


def read_from_segment(segmented: DataFrame, first: int) -> DataFrame:
    """Records of segments from `first` on, from their last checkpoint on if there is one."""
    rows = segmented.where(F.col("segment") >= first)
    mark = rows.where("is_checkpoint").agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("mark"))
    return rows.join(F.broadcast(mark), F.col("lsn") >= F.col("mark")).drop("mark")


def recover(records: DataFrame) -> DataFrame:
    """The newest entry of each key among the operations that no checkpoint covers; without one, among all."""
    covered = records.where("is_checkpoint").agg(F.coalesce(F.max("covered_lsn"), F.lit(0)).alias("covered"))
    rest = records.where("NOT is_checkpoint").join(F.broadcast(covered), F.col("lsn") > F.col("covered"))
    return resolve.latest(rest.select("key", "seq", "op", "value"))


def replay_counters(rows: DataFrame) -> DataFrame:
    """One row: records replayed, checkpoint records skipped, and all."""
    data = F.col("op").isin("PUT", "TOMBSTONE").cast("bigint")
    return rows.agg(F.coalesce(F.sum(data), F.lit(0)).alias("replayed"), F.coalesce(F.sum(1 - data), F.lit(0)).alias("skipped"), F.count("*").alias("total"))
