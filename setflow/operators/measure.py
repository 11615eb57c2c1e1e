"""Weighted cells as relations ``(key, weight)`` with unique keys; a missing key has weight 0."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box, BoxPartition
from ..sources.durable import stored
from .boxset import BoxSet


class BoxMeasure:
    def __init__(self, partition: BoxPartition, df: DataFrame):
        """``df`` has unique keys; ``from_frame`` sums duplicates."""
        self.partition, self.df = partition, df.select("key", "weight")

    @classmethod
    def from_frame(cls, partition: BoxPartition, df: DataFrame) -> BoxMeasure:
        return cls(partition, df.groupBy("key").agg(F.sum(F.col("weight").cast("double")).alias("weight")))

    @classmethod
    def from_dict(cls, spark: SparkSession, partition: BoxPartition, weights: Mapping[int, float]) -> BoxMeasure:
        import pyarrow as pa

        keys = sorted(weights)
        if keys and (keys[0] < 0 or keys[-1] >= partition.size):
            raise ValueError(f"keys must be in 0..{partition.size - 1}")
        return cls(partition, spark.createDataFrame(pa.table({"key": pa.array(keys, pa.int64()), "weight": pa.array([float(weights[k]) for k in keys], pa.float64())})))

    @classmethod
    def uniform(cls, cells: BoxSet, value: float = 1.0) -> BoxMeasure:
        return cls(cells.partition, cells.df.withColumn("weight", F.lit(float(value))))

    @classmethod
    def zeros(cls, cells: BoxSet) -> BoxMeasure:
        return cls.uniform(cells, 0.0)

    @classmethod
    def from_boxset(cls, cells: BoxSet, weights: Sequence[float]) -> BoxMeasure:
        """Weights in the order of the keys, for sets small enough to list on the driver."""
        keys = cells.keys()
        if len(keys) != len(weights):
            raise ValueError(f"{len(keys)} cells and {len(weights)} weights")
        return cls.from_dict(cells.df.sparkSession, cells.partition, dict(zip(keys, weights, strict=True)))

    @classmethod
    def from_weights(cls, cells: BoxSet, weights: DataFrame, key: str = "key", weight: str = "weight") -> BoxMeasure:
        """Weights of exactly these cells, from a table: a cell without a weight or with several, and a key of no cell, raise when rows are read."""
        own = weights.groupBy(F.col(key).cast("long").alias("key")).agg(F.count("*").alias("n"), F.first(F.col(weight).cast("double")).alias("weight"))
        both = cells.df.withColumn("here", F.lit(True)).join(own, "key", "full_outer")
        wrong = F.when(F.col("here").isNull(), "no cell of the set: ").when(F.col("n").isNull(), "no weight for key ").when(F.col("n") > 1, "several weights for key ")
        bad = F.raise_error(F.concat(wrong, F.coalesce(F.col("key").cast("string"), F.lit("null")))).cast("double")
        return cls(cells.partition, both.select("key", F.when(wrong.isNotNull(), bad).otherwise(F.col("weight")).alias("weight")))

    @classmethod
    def histogram(cls, partition: BoxPartition, points: DataFrame, cols: Sequence[str | Column], weight: Column | None = None) -> BoxMeasure:
        """Empirical measure of a table: per cell the number of its points, or the sum of a column."""
        xs = [F.col(c) if isinstance(c, str) else c for c in cols]
        w = F.sum(weight) if weight is not None else F.count("*")
        return cls(partition, points.where(partition.in_domain(xs)).groupBy(partition.key_expr(xs).alias("key")).agg(w.cast("double").alias("weight")))

    # sinks

    def to_dict(self) -> dict[int, float]:
        return {r["key"]: r["weight"] for r in self.df.orderBy("key").collect()}

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def stored(self) -> BoxMeasure:
        return BoxMeasure(self.partition, stored(self.df, "measure"))

    def support(self) -> BoxSet:
        return BoxSet(self.partition, self.df.where("weight != 0"))

    to_boxset = support

    def positive(self) -> BoxSet:
        return BoxSet(self.partition, self.df.where("weight > 0"))

    def negative(self) -> BoxSet:
        """The other side of ``positive``: weights of 0 and below."""
        return BoxSet(self.partition, self.df.where("weight <= 0"))

    def __getitem__(self, key: int) -> float:
        r = self.df.where(F.col("key") == int(key)).first()
        return 0.0 if r is None else r["weight"]

    def with_weight(self, key: int, value: float) -> BoxMeasure:
        """A measure that differs in one weight; ``KeyError`` outside the support."""
        if self.df.where(F.col("key") == int(key)).isEmpty():
            raise KeyError(key)
        return BoxMeasure(self.partition, self.df.withColumn("weight", F.when(F.col("key") == int(key), F.lit(float(value))).otherwise(F.col("weight"))))

    # arithmetic

    def _same(self, other: BoxMeasure | BoxSet) -> None:
        if self.partition != other.partition:
            raise ValueError("the operands are on different grids")

    def _sum(self, other: BoxMeasure, sign: float) -> BoxMeasure:
        self._same(other)
        both = self.df.union(other.df.withColumn("weight", F.col("weight") * F.lit(sign)))
        return BoxMeasure(self.partition, both.groupBy("key").agg(F.sum("weight").alias("weight")).where("weight != 0"))

    def __add__(self, other: BoxMeasure) -> BoxMeasure:
        return self._sum(other, 1.0)

    def __sub__(self, other: BoxMeasure) -> BoxMeasure:
        return self._sum(other, -1.0)

    def _scaled(self, f: Callable[[Column], Column]) -> BoxMeasure:
        return BoxMeasure(self.partition, self.df.withColumn("weight", f(F.col("weight"))))

    def __mul__(self, a: float) -> BoxMeasure:
        return self._scaled(lambda w: w * F.lit(float(a)))

    __rmul__ = __mul__

    def __truediv__(self, a: float) -> BoxMeasure:
        return self._scaled(lambda w: w / F.lit(float(a)))

    def __neg__(self) -> BoxMeasure:
        return self._scaled(lambda w: -w)

    def equals(self, other: BoxMeasure, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        if self.partition != other.partition:
            return False
        a, b = self.df.withColumnRenamed("weight", "a"), other.df.withColumnRenamed("weight", "b")
        both = a.join(b, "key", "full_outer").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
        return both.where(F.abs(F.col("a") - F.col("b")) > F.lit(atol) + F.lit(rtol) * F.abs("b")).isEmpty()

    # numbers

    def total(self) -> float:
        return self.df.agg(F.sum("weight").alias("s")).first()["s"] or 0.0

    def integrate(self, f: Callable[..., Column] | float) -> float:
        """Sum of ``f(center) * weight``; 0 for the empty measure."""
        xs = self.partition.center_exprs(F.col("key"))
        value = f(*xs) if callable(f) else F.lit(float(f))
        return self.df.agg(F.sum(value * F.col("weight")).alias("s")).first()["s"] or 0.0

    def norm_expr(self, p: float = 2.0) -> Column:
        """Aggregate expression of the L^p norm of the density."""
        if math.isinf(p):
            return F.coalesce(F.max(F.abs("weight")), F.lit(0.0))
        scaled = F.abs(F.col("weight") / F.lit(self.partition.cell_volume ** (1.0 / p)))
        return F.coalesce(F.pow(F.sum(F.pow(scaled, F.lit(float(p)))), F.lit(1.0 / p)), F.lit(0.0))

    def norm(self, p: float = 2.0) -> float:
        return self.df.agg(self.norm_expr(p).alias("s")).first()["s"]

    def normalize(self) -> BoxMeasure:
        n = self.norm(2.0)
        if n == 0.0:
            raise ValueError("a measure of norm 0 cannot be normalised")
        return self / n

    def __call__(self, region: BoxSet | Box) -> float:
        """Mass of a region."""
        if isinstance(region, Box):
            region = BoxSet.from_box(self.df.sparkSession, self.partition, region)
        self._same(region)
        return self.df.join(region.df, "key", "left_semi").agg(F.sum("weight").alias("s")).first()["s"] or 0.0

    def density(self, points: DataFrame, cols: Sequence[str], name: str = "density") -> DataFrame:
        """``points`` with the measure's density at each of them; 0 outside the support and the domain."""
        key = self.partition.key_or_null([F.col(c) for c in cols])
        w = self.df.select(F.col("key").alias("__key"), F.col("weight").alias("__weight"))
        found = points.withColumn("__at", key).join(w, F.col("__at") == F.col("__key"), "left")
        return found.withColumn(name, F.coalesce("__weight", F.lit(0.0)) / F.lit(self.partition.cell_volume)).drop("__at", "__key", "__weight")

    def marginal(self, dim: int) -> BoxMeasure:
        """Sum over one dimension: a measure on the grid of the others."""
        p = self.partition
        if not 0 <= dim < p.ndim or p.ndim < 2:
            raise IndexError(f"no dimension {dim} to sum over")
        keep = [d for d in range(p.ndim) if d != dim]
        rest = BoxPartition(Box([p.domain.center[d] for d in keep], [p.domain.radius[d] for d in keep]), [p.dims[d] for d in keep])
        multi = p.multi_exprs(F.col("key"))
        key = sum((multi[d] * F.lit(s) for d, s in zip(keep, rest.strides, strict=True)), F.lit(0).cast("long"))
        return BoxMeasure(rest, self.df.groupBy(key.alias("key")).agg(F.sum("weight").alias("weight")))

    def __repr__(self) -> str:
        return f"BoxMeasure({self.partition!r})"


def from_arrays(spark: SparkSession, partition: BoxPartition, keys: np.ndarray, weights: np.ndarray) -> BoxMeasure:
    """A measure the driver holds as arrays."""
    import pyarrow as pa

    return BoxMeasure(partition, spark.createDataFrame(pa.table({"key": pa.array(keys, pa.int64()), "weight": pa.array(weights, pa.float64())})))
