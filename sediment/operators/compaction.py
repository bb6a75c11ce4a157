"""Levelled compaction: which levels to merge, the merge itself, and what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators import resolve
from sediment.operators.history import with_neighbour

#: Runs that a level may hold; a level at its limit is merged into the next, the last one never.
LEVEL_LIMITS = {0: 4, 1: 8, 2: 16, 3: 32, 4: 64, 5: 128}
FAN_IN = LEVEL_LIMITS[0]


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEVEL_LIMITS.items()), "level bigint, max_runs bigint")


def plan(manifest: DataFrame, limits: DataFrame) -> DataFrame:
    """(level, runs, max_runs, triggers) for the levels that hold runs."""
    counts = manifest.groupBy("level").agg(F.count("*").alias("runs"))
    return counts.join(F.broadcast(limits), "level").withColumn("triggers", (F.col("runs") >= F.col("max_runs")) & (F.col("level") < max(LEVEL_LIMITS)))


def merge(entries: DataFrame, *, drop_tombstones: bool) -> DataFrame:
    """One run of the newest entry of each key. Tombstones may go only if no deeper level can hold their keys."""
    merged = resolve.latest(entries.drop("run"))
    return merged.where(F.col("op") == "PUT") if drop_tombstones else merged


def dropped(entries: DataFrame) -> DataFrame:
    """One row: entries merged, those superseded, tombstones dropped, and entries left."""
    top = entries.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("seq", "op")).alias("top"))
    tomb = (F.col("top.op") == "TOMBSTONE").cast("bigint")
    return top.agg(F.sum("n").alias("entries"), F.sum(F.col("n") - 1).alias("superseded"), F.sum(tomb).alias("tombstones"), F.sum(1 - tomb).alias("kept"))


def level_counts(runs: DataFrame) -> DataFrame:
    """(flush, l0, l1, compactions) after each flush, under the policy that merges all of L0 and L1 at the limit."""
    n = F.col("run") + 1
    return runs.select(n.alias("flush"), (n % FAN_IN).alias("l0"), (n >= FAN_IN).cast("bigint").alias("l1"), F.floor(n / FAN_IN).cast("bigint").alias("compactions"))


def write_amplification(log: DataFrame, entries: DataFrame, ops: int) -> DataFrame:
    """(flushed, rewritten, amplification): entries that compactions write again for each one flushed.

    A compaction every FAN_IN runs writes what is live then. A version is live from its seq up to the next of
    its key, so it is written once for each compaction in between: no compaction is replayed.
    """
    step = ops * FAN_IN
    last = log.agg(F.max("seq").alias("last"))
    spans = with_neighbour(log.select("key", "seq", "op"), F.col("seq"), "following", after=True).join(F.broadcast(last))
    ends = F.least(F.coalesce("following", F.col("last") + 1), F.floor(F.col("last") / step) * step + 1)
    times = F.greatest(F.lit(0), F.floor((ends - 1) / step) - F.floor((F.col("seq") - 1) / step))
    again = spans.agg(F.coalesce(F.sum(F.when(F.col("op") == "PUT", times)), F.lit(0)).cast("bigint").alias("rewritten"))
    flushed = entries.agg(F.count("*").alias("flushed"))
    return flushed.join(again).select("flushed", "rewritten", F.round(F.col("rewritten") / F.col("flushed"), 6).alias("amplification"))


def stale(planned: DataFrame, current: DataFrame) -> DataFrame:
    """The planned inputs that are no longer in the manifest; a merge with any is given up."""
    return planned.join(current, "run", "left_anti")
