"""The append-only operation log: (seq, key, op, value), one row for each put or delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, TOMBSTONE = "PUT", "TOMBSTONE"


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical log of the events table."""
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log(events: DataFrame) -> DataFrame:
    """Events as operations: an error deletes its user's key, any other event puts it."""
    gone = F.col("event_type") == "error"
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.when(gone, TOMBSTONE).otherwise(PUT).alias("op"),
        F.when(~gone, F.concat("event_type", F.lit("|"), "props")).alias("value"),
    )
