"""Reads of the current state: point, batch and range lookups, and reads as of a sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators import resolve


def get(log: DataFrame, key: str) -> DataFrame:
    """The live row of one key, or none; the filter reaches the scan."""
    return resolve.live(log.where(F.col("key") == key))


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, found) for each row of keys (key); a missing or deleted key has a null value."""
    wanted = resolve.live(log.join(keys.select("key").distinct(), "key", "left_semi"))
    return keys.join(wanted.select("key", "value", F.lit(True).alias("hit")), "key", "left").select("key", "value", F.coalesce("hit", F.lit(False)).alias("found"))


def scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """The live rows with low <= key <= high, in key order."""
    return resolve.live(log.where(F.col("key").between(low, high))).orderBy("key")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live rows as they were after operation `seq`."""
    return resolve.live(log.where(F.col("seq") <= seq))
