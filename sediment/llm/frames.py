"""What the operators share: reading tables, written intermediate tables, shipping this package, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.sources.shared import shared_dir, ship

#: Rows in an Arrow batch: with texts of a few KB a batch is a few MB.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable on the executors and keep Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder so that lost executors lose nothing."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n, self.tables = spark, shared_dir(spark, "sediment"), 0, []

    def save(self, df: DataFrame, *, narrow: bool = False) -> DataFrame:
        """df as a written table. narrow: of short rows, for which two tasks a core are enough after any shuffle."""
        self.n += 1
        if narrow:
            df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sediment_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(t._sediment_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.tables = [x for x in self.tables if x is not t]

    def sweep(self, *keep: DataFrame) -> None:
        """Delete all tables but these, and let Spark remove the shuffle files that made them."""
        self.drop(*[t for t in self.tables if all(t is not k for k in keep)])
        gc.collect()  # frames that Python holds keep their shuffles
        self.spark.sparkContext._jvm.System.gc()


def batch(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.float32(): "float", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>", pa.list_(pa.binary()): "array<binary>"}
    return ", ".join(f"`{k}` {names[t]}" for k, t in schema.items())


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key in turn, from batches sorted by bigint keys; holds one key's rows at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(n - 1, dtype=bool)
        for c in cols:
            cut |= c[1:] != c[:-1]
        ends = (np.flatnonzero(cut) + 1).tolist()
        for lo, hi in zip([0, *ends], [*ends, n], strict=True):
            k = tuple(c[lo] for c in cols)
            if held and k != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            last = k
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes; each round is written, so a lost executor costs one round.
    Self-loops keep isolated nodes. A hub's edges are aggregated before they shuffle, and the joins
    back to a hub are plain equi-joins, which adaptive execution can split.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), narrow=True)
    before = None
    while True:
        # large star: every larger neighbour of u points at the smallest of u and its neighbours
        both = now.union(now.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), narrow=True)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.union(now.where("u = v")).distinct(), narrow=True)
        # small star: every smaller neighbour of u, and u itself, points at the smallest of them
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), narrow=True)
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        after = scratch.save(small.distinct(), narrow=True)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now, low, large, low2)
        now = after
        if mark == before:
            break
        before = mark
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def source_stats_bytes(df: DataFrame) -> int:
    """The size the optimiser expects of a frame, from file sizes: no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
