"""Incremental cover and histogram of a stream of points (an extension: the batch engine has no streams)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BoxPartition


def stream_histogram(points: DataFrame, partition: BoxPartition, cols: Sequence[str], time_col: str, window: str, lateness: str) -> DataFrame:
    """``window, key, n`` per event-time window; points later than ``lateness`` are dropped with their state."""
    xs = [F.col(c) for c in cols]
    keyed = points.where(partition.in_domain(xs)).select(F.col(time_col).alias("ts"), partition.key_expr(xs).alias("key"))
    return keyed.withWatermark("ts", lateness).groupBy(F.window("ts", window), "key").agg(F.count("*").alias("n"))


def stream_cover(points: DataFrame, partition: BoxPartition, cols: Sequence[str], time_col: str, lateness: str) -> DataFrame:
    """``key``: cells as they are first seen within the watermark."""
    xs = [F.col(c) for c in cols]
    keyed = points.where(partition.in_domain(xs)).select(F.col(time_col).alias("ts"), partition.key_expr(xs).alias("key"))
    return keyed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["key"]).select("key")
