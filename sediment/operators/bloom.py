"""Membership filters of runs as tables of set slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.slots import HASHES, SLOTS, key_slots
from sediment.sources.shared import ship


def positions(keys: DataFrame) -> DataFrame:
    """keys with s0, s1 and s2, the slots of each row's key; nothing is shuffled."""
    ship(keys.sparkSession)
    return keys.withColumn("s", key_slots("key")).select(*keys.columns, *[F.col("s")[k].alias(f"s{k}") for k in range(HASHES)])


def filters(entries: DataFrame) -> DataFrame:
    """(run, slot): the set slots of each run's filter."""
    at = positions(entries.select("run", "key"))
    return at.select("run", F.explode(F.array("s0", "s1", "s2")).alias("slot")).distinct()


def might_contain(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """(run, key, maybe) for each row of keys (run, key): whether all its slots are set in the run's filter."""
    at = positions(keys).select("run", "key", F.explode(F.array_distinct(F.array("s0", "s1", "s2"))).alias("slot"))
    hit = at.join(filters.withColumn("hit", F.lit(True)), ["run", "slot"], "left")
    return hit.groupBy("run", "key").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("maybe"))


def expected_false_positives(n):
    """The share of absent keys that a filter of n keys lets through."""
    return F.pow(1 - F.exp(-HASHES * n / F.lit(float(SLOTS))), F.lit(float(HASHES)))
