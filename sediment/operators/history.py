"""Neighbouring versions of a key, without one task that sees all versions of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers in a bucket: the most rows of one key that one window holds.
BUCKET = 1 << 16


def with_neighbour(log: DataFrame, value: Column, name: str, *, after: bool = False, bucket: int = BUCKET) -> DataFrame:
    """log with `name`: the value at the key's version before (or after) this one, null at the first (or last).

    Versions meet within buckets of sequence numbers; of each key and bucket, only the version next to the neighbouring
    bucket goes further.
    """
    parts = log.withColumns({"_bucket": F.floor(F.col("seq") / bucket), "_value": value})
    order = F.desc("seq") if after else F.asc("seq")
    edge = F.min if after else F.max
    edges = parts.groupBy("key", "_bucket").agg(edge(F.struct("seq", "_value")).alias("_edge"))
    outer = Window.partitionBy("key").orderBy(F.desc("_bucket") if after else F.asc("_bucket"))
    edges = edges.select("key", "_bucket", F.lag("_edge").over(outer).alias("_beyond"))
    inside = Window.partitionBy("key", "_bucket").orderBy(order)
    near = parts.withColumn("_near", F.lag(F.struct("seq", "_value")).over(inside)).join(edges, ["key", "_bucket"])
    return near.withColumn(name, F.coalesce("_near", "_beyond")["_value"]).drop("_bucket", "_value", "_near", "_beyond")
