"""Running sums and row numbers over a global order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import stored


#: Rows that one task orders.
ROWS_PER_PART = 1 << 21


def running(rows: DataFrame, order: str, value: Column, parts: int | None = None) -> DataFrame:
    """``rows`` with ``upto`` (inclusive running sum of ``value`` in the order of a column of distinct values) and ``total``.

    Two levels: rows are range-partitioned by the column and sum inside their part; a table with one row per part
    carries the offsets. Without ``parts`` there are as many as hold ``ROWS_PER_PART`` rows each, 8 at least.
    """
    if parts is None:
        rows = stored(rows, "unordered")
        parts = max(8, -(-rows.count() // ROWS_PER_PART))
    ranged = stored(rows.withColumn("__v", value).repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__part").agg(F.sum("__v").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__part", before.alias("__before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    own = F.sum("__v").over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__own", own).join(sums, "__part").withColumn("upto", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before", "__v")


def numbered(rows: DataFrame, order: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their place, from 0, in the order of a column of distinct values."""
    return running(rows, order, F.lit(1).cast("long"), parts).withColumn(name, F.col("upto") - 1).drop("upto", "total")
