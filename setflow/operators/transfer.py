"""Transfer operators as edge relations ``(src, dst, hits, weight)``.

A weight is the hits of an edge over all hits of its source inside the codomain, so weights of a source sum to 1.
Sources without such hits have no row; mass on them is lost, as in a matrix with a zero column. Products with
measures are a join and a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import stored
from .boxset import BoxSet
from .maps import BoxMap
from .measure import BoxMeasure


def normalised(counts: DataFrame, by: tuple[str, ...] = ("src",)) -> DataFrame:
    """``counts(..., src, dst, hits)`` with ``weight``: hits over all hits of the rows that agree in ``by``."""
    total = F.sum("hits").over(Window.partitionBy(*by))
    return counts.withColumn("weight", F.col("hits") / total)


class TransferOperator:
    def __init__(self, box_map: BoxMap, domain: BoxSet, codomain: BoxSet | None = None, keep: bool = True):
        """``codomain`` defaults to the image of the domain. With ``keep`` the edges are computed once, as a stored table."""
        self.map, self.domain = box_map, domain
        counts = box_map.counted(domain, (codomain or domain).partition)
        if codomain is None:
            counts = stored(counts, "hits") if keep else counts
            codomain = BoxSet(domain.partition, counts.select(F.col("dst").alias("key")).distinct())
        else:
            counts = counts.join(codomain.df.withColumnRenamed("key", "dst"), "dst", "left_semi")
        self.codomain = codomain
        edges = normalised(counts)
        self.edges = stored(edges, "edges") if keep else edges

    @classmethod
    def from_edges(cls, edges: DataFrame, domain: BoxSet, codomain: BoxSet) -> TransferOperator:
        """An operator estimated elsewhere; ``edges(src, dst, hits)``."""
        op = cls.__new__(cls)
        op.map, op.domain, op.codomain, op.edges = None, domain, codomain, normalised(edges)
        return op

    def _check(self, mu: BoxMeasure, cells: BoxSet) -> None:
        if mu.partition != cells.partition:
            raise ValueError("the measure is on another grid")

    def push_forward(self, mu: BoxMeasure) -> BoxMeasure:
        self._check(mu, self.domain)
        m = mu.df.select(F.col("key").alias("src"), F.col("weight").alias("m"))
        out = self.edges.join(m, "src").groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("weight") * F.col("m")).alias("weight"))
        return BoxMeasure(self.codomain.partition, out.where("weight != 0"))

    __matmul__ = push_forward

    def pull_back(self, mu: BoxMeasure) -> BoxMeasure:
        self._check(mu, self.codomain)
        m = mu.df.select(F.col("key").alias("dst"), F.col("weight").alias("m"))
        out = self.edges.join(m, "dst").groupBy(F.col("src").alias("key")).agg(F.sum(F.col("weight") * F.col("m")).alias("weight"))
        return BoxMeasure(self.domain.partition, out.where("weight != 0"))

    def shape(self) -> tuple[int, int]:
        return self.codomain.count(), self.domain.count()

    def nnz(self) -> int:
        return self.edges.count()

    def raw_hits(self) -> int:
        return self.edges.agg(F.sum("hits").alias("n")).first()["n"] or 0

    def hits_per_cell(self) -> DataFrame:
        """``(key, weight)``: hits of every domain cell, 0 included; the work of a cell for load balancing."""
        n = self.edges.groupBy(F.col("src").alias("key")).agg(F.sum("hits").alias("n"))
        return self.domain.df.join(n, "key", "left").select("key", F.coalesce("n", F.lit(0).cast("long")).alias("weight"))

    def eigs(self, k: int = 3, which: str = "LM", v0: BoxMeasure | None = None, tol: float | None = None):
        from .spectral import eigs

        return eigs(self, k, which, v0, tol)

    def svds(self, k: int = 3):
        from .spectral import svds

        return svds(self, k)

    def __repr__(self) -> str:
        return f"TransferOperator({self.map!r}, domain={self.domain!r})"


class FramedTransfer:
    """Transfer operators of a nonautonomous map, one per start time, as one relation ``(frame, src, dst, hits, weight)``."""

    def __init__(self, box_map, domain: BoxSet, times, codomain: BoxSet | None = None, keep: bool = True):
        """Hits outside ``codomain``, where one is given, do not count."""
        self.map, self.domain, self.times = box_map, domain, list(times)
        counts = box_map.frames(domain, self.times, (codomain or domain).partition)
        if codomain is not None:
            counts = counts.join(codomain.df.withColumnRenamed("key", "dst"), "dst", "left_semi").select("frame", "src", "dst", "hits")
        self.codomain = codomain
        edges = normalised(counts, ("frame", "src"))
        self.edges = stored(edges, "edges") if keep else edges

    def push_forward(self, measures: DataFrame) -> DataFrame:
        """``measures(frame, key, weight)`` moved each by its frame's operator."""
        m = measures.select("frame", F.col("key").alias("src"), F.col("weight").alias("m"))
        out = self.edges.join(m, ["frame", "src"]).groupBy("frame", F.col("dst").alias("key")).agg(F.sum(F.col("weight") * F.col("m")).alias("weight"))
        return out.where("weight != 0")

    def at(self, frame: int) -> TransferOperator:
        """One frame's operator, with its spectrum and all."""
        own = self.edges.where(F.col("frame") == frame)
        codomain = self.codomain or BoxSet(self.domain.partition, own.select(F.col("dst").alias("key")).distinct())
        return TransferOperator.from_edges(own.select("src", "dst", "hits"), self.domain, codomain)
