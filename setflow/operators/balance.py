"""Space-filling-curve shards of cell sets, and how even they are.

Both splits need a running sum along the Morton order, which no single task computes; see ``ordering``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import stored
from .boxset import BoxSet
from .ordering import running


def morton_codes(cells: BoxSet) -> DataFrame:
    return cells.df.select("key", cells.partition.morton_expr(F.col("key")).alias("morton"))


def uniform_shards(cells: BoxSet, shards: int, parts: int | None = None) -> DataFrame:
    """``(key, morton, shard)``: equal counts along the curve; the first shards get one more."""
    rows = running(morton_codes(cells), "morton", F.lit(1).cast("long"), parts)
    at, size, more = F.col("upto") - 1, F.expr(f"total div {shards}"), F.expr(f"total % {shards}")
    big = more * (size + 1)
    shard = F.when(at < big, F.floor(at / (size + 1))).otherwise(more + F.floor((at - big) / F.greatest(size, F.lit(1))))
    return rows.select("key", "morton", shard.cast("int").alias("shard"))


def weighted_shards(cells: BoxSet, weights: DataFrame, shards: int, parts: int | None = None) -> DataFrame:
    """``(key, morton, weight, shard)``: cuts where the running weight reaches multiples of total / shards.

    ``weights(key, weight)``; cells without a weight count 0. If all weights are 0 the split is uniform.
    """
    rows = morton_codes(cells).join(weights.select("key", "weight"), "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    rows = stored(rows, "weights")
    if (rows.agg(F.sum("weight").alias("s")).first()["s"] or 0) == 0:
        return uniform_shards(cells, shards, parts).join(rows.select("key", "weight"), "key").select("key", "morton", "weight", "shard")
    run = running(rows, "morton", F.col("weight"), parts)
    # position i starts shard s if the running sum reaches s / shards of the total at i: count the cuts below
    cuts = F.array(*[F.lit(float(s)) * (F.col("total") / F.lit(float(shards))) for s in range(1, shards)]) if shards > 1 else F.array().cast("array<double>")
    shard = F.size(F.filter(cuts, lambda c: c <= F.col("upto")))
    return run.select("key", "morton", "weight", shard.cast("int").alias("shard"))


def shard_weights(assigned: DataFrame, shards: int, weight: str | None = "weight") -> DataFrame:
    """``(shard, cells, weight)`` for every shard, empty ones too."""
    w = F.sum(weight) if weight else F.count("*")
    found = assigned.groupBy("shard").agg(F.count("*").alias("cells"), w.alias("weight"))
    all_ = assigned.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return all_.join(found, "shard", "left").select("shard", F.coalesce("cells", F.lit(0).cast("long")).alias("cells"), F.coalesce("weight", F.lit(0)).alias("weight"))


def imbalance(weights: DataFrame) -> DataFrame:
    """One row: ``imbalance`` (max over min, infinite if a shard is empty, 1 for one shard), ``idle`` (mean share of waiting), ``assessment``."""
    r = weights.agg(F.max("weight").cast("double").alias("hi"), F.min("weight").cast("double").alias("lo"), F.avg("weight").alias("mean"), F.count("*").alias("n"))
    ratio = F.when(F.col("n") <= 1, F.lit(1.0)).when(F.col("lo") == 0, F.lit(float("inf"))).otherwise(F.col("hi") / F.col("lo"))
    idle = F.when(F.col("hi") > 0, (F.col("hi") - F.col("mean")) / F.col("hi")).otherwise(F.lit(0.0))
    r = r.select(ratio.alias("imbalance"), idle.alias("idle"))
    return r.withColumn("assessment", F.when(F.col("imbalance") < 1.5, "even").when(F.col("imbalance") < 3, "uneven").otherwise("severe"))


def compute_imbalance(counts: list[float]) -> float:
    if len(counts) <= 1:
        return 1.0
    return float("inf") if min(counts) == 0 else max(counts) / min(counts)


def should_rebalance(counts: list[float], threshold: float = 2.0, min_total: float = 500) -> bool:
    return sum(counts) >= min_total and compute_imbalance(counts) > threshold
