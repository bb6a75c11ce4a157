"""Latest version wins: the newest row of each key, tombstones kept or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.oplog import PUT


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The row of the highest seq for each key (and each `by`), tombstones included.

    One hash aggregate: partial maxima combine before the shuffle, so a hot key moves one row a task.
    """
    keys = [*by, "key"]
    rest = [c for c in log.columns if c not in keys and c != "seq"]
    top = log.groupBy(*keys).agg(F.max(F.struct("seq", *rest)).alias("top"))
    return top.select(*keys, "top.seq", *[f"top.{c}" for c in rest]).select(*log.columns)


def live(log: DataFrame) -> DataFrame:
    """The current value of every key that is not deleted."""
    return latest(log).where(F.col("op") == PUT)
