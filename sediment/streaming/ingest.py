"""Structured Streaming ingest: micro-batches of events become sorted runs of their newest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators import oplog, resolve
from sediment.sources.shared import shared_dir


def write_run(path: str):
    """A batch function: one Parquet folder for a batch, named by it, so that a repeated batch replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = resolve.latest(batch)
        newest.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/run={batch_id}")

    return run


def ingest_events(spark: SparkSession, sf_dir: str, *, files_per_batch: int = 1) -> DataFrame:
    """Streams the events files of a folder into runs until none is left, and returns the runs' entries."""
    path = shared_dir(spark, "stream")
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may stand for one file
    log = oplog.as_log(stream)
    started = log.writeStream.foreachBatch(write_run(path)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(path).select("seq", "key", "op", "value").withColumn("seq", F.col("seq").cast("bigint"))
