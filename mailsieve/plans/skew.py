"""Exact ordering work without putting one key's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_position(frame: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                     bucket_order: Column, output: str = "position") -> DataFrame:
    """1-based position of each row within its key.

    ``bucket`` cuts the order into ranges: every row of a bucket comes before every row of a later one in
    ``bucket_order``. Buckets are counted with map-side combining, their running totals give each bucket's
    offset, and only rows of one (key, bucket) are sorted together. A key of any size is spread over its
    buckets, and the rows are shuffled once.
    """
    frame = frame.withColumn("_bucket", bucket)
    sizes = frame.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        frame.join(offsets, [*keys, "_bucket"])
        .withColumn(output, F.row_number().over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )
