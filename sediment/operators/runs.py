"""Sorted runs: batches of the log reduced to their newest entries, with manifest, index and file sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions import binary
from sediment.operators import resolve

#: Operations in a run.
RUN_OPS = 500


def assign(log: DataFrame, ops: int = RUN_OPS) -> DataFrame:
    """The log with `run`: a fixed number of operations makes one."""
    return log.withColumn("run", F.floor((F.col("seq") - 1) / ops).cast("bigint"))


def entries(log: DataFrame, ops: int = RUN_OPS) -> DataFrame:
    """(run, key, seq, op, value): the newest entry of each key in each run, tombstones included."""
    return resolve.latest(assign(log, ops), "run").select("run", "key", "seq", "op", "value")


def manifest(entries: DataFrame) -> DataFrame:
    """One row for each run: bounds of its keys and sequence numbers, entries and tombstones."""
    return entries.groupBy("run").agg(
        F.lit(0).cast("bigint").alias("level"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count("*").alias("n"),
        F.sum((F.col("op") == "TOMBSTONE").cast("bigint")).alias("n_tomb"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def index(entries: DataFrame) -> DataFrame:
    """(run, key, offset): where each entry's frame starts behind the run's header."""
    before = Window.partitionBy("run").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    size = binary.run_frame_size(F.col("op"), F.col("key"), F.col("value"))
    return entries.select("run", "key", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint").alias("offset"))


def index_floor(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(run, probe, floor_key, offset): the greatest indexed key up to each probe; null and -1 below the first.

    probes is a small stated set: it is broadcast, and each run keeps one row for a probe before any shuffle.
    """
    best = F.max(F.when(F.col("key") <= F.col("probe"), F.struct("key", "offset")))
    return index.join(F.broadcast(probes)).groupBy("run", "probe").agg(best.alias("best")).select("run", "probe", F.col("best.key").alias("floor_key"), F.coalesce("best.offset", F.lit(-1)).alias("offset"))


def file_sizes(entries: DataFrame) -> DataFrame:
    """(run, index_bytes, frame_bytes, file_bytes) of the runs' files."""
    size = binary.run_frame_size(F.col("op"), F.col("key"), F.col("value"))
    out = entries.groupBy("run").agg((binary.INDEX_HEADER + F.sum(12 + binary.key_bytes(F.col("key")))).alias("index_bytes"), F.sum(size).alias("frame_bytes"))
    return out.withColumn("file_bytes", binary.RUN_HEADER + F.col("index_bytes") + F.col("frame_bytes"))


def first_hit(entries: DataFrame) -> DataFrame:
    """(key, run): the newest run that holds each key."""
    return entries.groupBy("key").agg(F.max("run").alias("run"))
