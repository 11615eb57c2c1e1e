"""Sets of grid cells as relations ``(key)`` with unique keys.

Keys are unique by construction, so intersections and differences are semi and anti joins and need no further
distinct. Nothing is sorted until rows are shown.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box, BoxPartition
from ..sources.durable import stored


def key_frame(spark: SparkSession, keys: Iterable[int]) -> DataFrame:
    """A relation of a few keys that the driver knows."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"key": pa.array(np.unique(np.asarray(list(keys), np.int64)), pa.int64())}))


class BoxSet:
    def __init__(self, partition: BoxPartition, df: DataFrame):
        """``df`` has a column ``key`` of distinct valid keys; use the constructors below for anything else."""
        self.partition, self.df = partition, df if df.columns == ["key"] else df.select("key")

    # sources

    @classmethod
    def full(cls, spark: SparkSession, partition: BoxPartition) -> BoxSet:
        return cls(partition, partition.all_keys(spark))

    @classmethod
    def empty(cls, spark: SparkSession, partition: BoxPartition) -> BoxSet:
        return cls(partition, spark.range(0).withColumnRenamed("id", "key"))

    @classmethod
    def from_keys(cls, spark: SparkSession, partition: BoxPartition, keys: Iterable[int]) -> BoxSet:
        keys = np.unique(np.asarray(list(keys), np.int64))
        if len(keys) and (keys[0] < 0 or keys[-1] >= partition.size):
            raise ValueError(f"keys must be in 0..{partition.size - 1}")
        return cls(partition, key_frame(spark, keys))

    @classmethod
    def from_frame(cls, partition: BoxPartition, df: DataFrame, key: str = "key") -> BoxSet:
        """Keys of any table: duplicates and nulls go, a key outside the grid raises when rows are read."""
        k = F.col(key).cast("long")
        checked = F.when((k >= 0) & (k < F.lit(partition.size)), k).otherwise(F.raise_error(F.concat(F.lit("key outside the grid: "), k.cast("string"))).cast("long"))
        return cls(partition, df.where(k.isNotNull()).select(checked.alias("key")).distinct())

    @classmethod
    def cover(cls, partition: BoxPartition, points: DataFrame, cols: Sequence[str | Column]) -> BoxSet:
        """Cells that hold a point of a table; points outside the domain, and nulls, are ignored."""
        xs = [F.col(c) if isinstance(c, str) else c for c in cols]
        return cls(partition, points.where(partition.in_domain(xs)).select(partition.key_expr(xs).alias("key")).distinct())

    @classmethod
    def from_box(cls, spark: SparkSession, partition: BoxPartition, query: Box) -> BoxSet:
        return cls(partition, partition.keys_in_box(spark, query))

    # sinks

    def keys(self) -> list[int]:
        return [r["key"] for r in self.df.orderBy("key").collect()]

    def __iter__(self):
        return iter(self.keys())

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def boxes(self) -> DataFrame:
        """``key, center, radius``."""
        p = self.partition
        radius = F.array(*[F.lit(r) for r in p.cell_radius.tolist()])
        return self.df.select("key", F.array(*p.center_exprs(F.col("key"))).alias("center"), radius.alias("radius"))

    def stored(self) -> BoxSet:
        """The same set, computed once and kept as a table in the shared folder."""
        return self if hasattr(self.df, "_stored_at") else BoxSet(self.partition, stored(self.df, "cells"))

    def __contains__(self, key: int) -> bool:
        return not self.df.where(F.col("key") == int(key)).isEmpty()

    # geometry

    def centers(self) -> DataFrame:
        return self.df.select("key", *[c.alias(f"x{d}") for d, c in enumerate(self.partition.center_exprs(F.col("key")))])

    def multi_indices(self) -> DataFrame:
        return self.df.select("key", *[m.alias(f"m{d}") for d, m in enumerate(self.partition.multi_exprs(F.col("key")))])

    def bounds(self) -> DataFrame:
        """One row ``lo0, hi0, ...``; nulls for the empty set."""
        p = self.partition
        out = []
        for d, (c, r) in enumerate(zip(p.center_exprs(F.col("key")), p.cell_radius.tolist(), strict=True)):
            out += [F.min(c - F.lit(r)).alias(f"lo{d}"), F.max(c + F.lit(r)).alias(f"hi{d}")]
        return self.df.agg(*out)

    def bounds_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corner; (+inf, -inf) for the empty set."""
        row, n = self.bounds().first(), self.partition.ndim
        lo = [np.inf if row[f"lo{d}"] is None else row[f"lo{d}"] for d in range(n)]
        return np.array(lo), np.array([-np.inf if row[f"hi{d}"] is None else row[f"hi{d}"] for d in range(n)])

    def subdivide(self, dim: int) -> BoxSet:
        fine = self.partition.subdivide(dim)
        return BoxSet(fine, self.df.select(F.explode(F.array(*self.partition.child_exprs(F.col("key"), dim))).alias("key")))

    def subdivide_all(self) -> BoxSet:
        return BoxSet(self.partition.subdivide_all(), self.df.select(F.explode(F.array(*self.partition.all_child_exprs(F.col("key")))).alias("key")))

    def refine(self) -> BoxSet:
        """Subdivide along the dimension with the fewest cells."""
        return self.subdivide(self.partition.next_dim())

    def repartition(self, new: BoxPartition) -> BoxSet:
        """Cells of another grid whose center lies in a cell of this set, edges widened by 1e-10 of the smaller radius.

        Every cell of this set makes the few cells of the new grid whose center can lie in it, by key arithmetic per axis,
        and tests their centers exactly. So the work is in proportion to the two sets, whatever lies between, and the one
        shuffle makes keys distinct that two neighbours share.
        """
        old, n = self.partition, self.partition.ndim
        eps = np.minimum(old.cell_radius, new.cell_radius) * 1e-10
        rows = self.df.select(*[c.alias(f"c{d}") for d, c in enumerate(old.center_exprs(F.col("key")))])
        tests = []
        for d in range(n):
            start, width = float(new.domain.lo[d]), float(2.0 * new.cell_radius[d])
            r, e = float(old.cell_radius[d]), float(eps[d])
            # indices whose center start + width * (m + 0.5) may lie in [c - r - e, c + r + e); one more on both sides for rounding
            first, last = (F.floor((F.col(f"c{d}") + F.lit(s * (r + e)) - F.lit(start)) / F.lit(width) - F.lit(0.5)) + F.lit(k) for s, k in ((-1.0, -1), (1.0, 2)))
            first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(new.dims[d] - 1))
            rows = rows.withColumn(f"m{d}", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
            center = F.lit(start) + F.lit(width) * (F.col(f"m{d}") + F.lit(0.5))
            rows = rows.where((center >= F.col(f"c{d}") - F.lit(r) - F.lit(e)) & (center < F.col(f"c{d}") + F.lit(r) + F.lit(e)))
        key = sum((F.col(f"m{d}") * F.lit(s) for d, s in enumerate(new.strides)), F.lit(0).cast("long"))
        return BoxSet(new, rows.select(key.alias("key")).distinct())

    # algebra

    def _same(self, other: BoxSet) -> None:
        if self.partition != other.partition:
            raise ValueError("the sets are on different grids")

    def __or__(self, other: BoxSet) -> BoxSet:
        self._same(other)
        return BoxSet(self.partition, self.df.union(other.df).distinct())

    def __and__(self, other: BoxSet) -> BoxSet:
        self._same(other)
        return BoxSet(self.partition, self.df.join(other.df, "key", "left_semi"))

    def __sub__(self, other: BoxSet) -> BoxSet:
        self._same(other)
        return BoxSet(self.partition, self.df.join(other.df, "key", "left_anti"))

    def __xor__(self, other: BoxSet) -> BoxSet:
        self._same(other)
        both = self.df.union(other.df).groupBy("key").agg(F.count("*").alias("n"))
        return BoxSet(self.partition, both.where("n = 1"))

    union, intersection, difference, symmetric_difference = __or__, __and__, __sub__, __xor__

    def __le__(self, other: BoxSet) -> bool:
        return (self - other).is_empty()

    def __ge__(self, other: BoxSet) -> bool:
        return (other - self).is_empty()

    issubset, issuperset = __le__, __ge__

    def equals(self, other: BoxSet) -> bool:
        return self.partition == other.partition and (self ^ other).is_empty()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, BoxSet) and self.equals(other)

    def fingerprint(self) -> tuple[int, int]:
        """Count and order-free hash of the keys: equal for equal sets."""
        r = self.df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("h")).first()
        return r["n"], r["h"] or 0

    def __hash__(self) -> int:
        return hash((self.partition, self.fingerprint()))

    def __repr__(self) -> str:
        return f"BoxSet({self.partition!r})"
