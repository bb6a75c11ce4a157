"""Running sums over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values in a bucket: the rows of one window when order values are dense.
BUCKET = 1 << 16


def running_sum(df: DataFrame, order: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """df with `name`: the sum of value over the rows before this one in `order`, a unique number.

    Rows are summed within buckets of order values; only one total for each bucket meets in one task.
    """
    parts = df.withColumns({"_bucket": F.floor(F.col(order) / bucket), "_value": value})
    totals = parts.groupBy("_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(totals, "_bucket")
    out = joined.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return out.drop("_bucket", "_value", "_before")
