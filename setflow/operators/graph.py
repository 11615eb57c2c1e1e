"""Strongly connected components and recurrence of cell graphs.

Up to ``LOCAL_EDGES`` edges, a checked number, the graph is solved on the driver by an iterative depth-first search.
Beyond that it stays distributed: cells without an incoming or outgoing edge are trimmed; every remaining cell takes
the largest key that reaches it as colour; the cells from which a colour's own cell is reached within the colour are its
component; they leave and the rest goes on. Labels are the smallest key of a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import discard, stored
from .boxset import BoxSet
from .measure import BoxMeasure
from .ordering import numbered

LOCAL_EDGES = 2_000_000


def scc_arrays(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, for each, the smallest key of its component."""
    keys, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = len(keys)
    s, d = at[: len(src)], at[len(src) :]
    order = np.argsort(s, kind="stable")
    heads, start = d[order].tolist(), np.searchsorted(s[order], np.arange(n + 1)).tolist()
    number, low, on, label = [0] * n, [0] * n, [False] * n, [0] * n
    count, path = 0, []
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        on[root] = True
        path.append(root)
        work = [(root, start[root])]
        while work:
            v, e = work.pop()
            if e < start[v + 1]:
                work.append((v, e + 1))
                w = heads[e]
                if not number[w]:
                    count += 1
                    number[w] = low[w] = count
                    on[w] = True
                    path.append(w)
                    work.append((w, start[w]))
                elif on[w]:
                    low[v] = min(low[v], number[w])
                continue
            if low[v] == number[v]:
                members = []
                while True:
                    w = path.pop()
                    on[w] = False
                    members.append(w)
                    if w == v:
                        break
                least = min(members)
                for w in members:
                    label[w] = least
            if work:
                u = work[-1][0]
                low[u] = min(low[u], low[v])
    return keys, keys[np.array(label, np.int64)] if n else keys


def _spread(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``values(key, v)`` carried along ``edges(src, dst)`` until nothing grows: the largest value that reaches each key."""
    while True:
        sent = edges.join(values.withColumnRenamed("key", "src"), "src").select(F.col("dst").alias("key"), "v")
        new = stored(values.union(sent).groupBy("key").agg(F.max("v").alias("v")), "colours")
        if new.join(values.withColumnRenamed("v", "was"), "key").where("v != was").isEmpty():
            return new
        discard(values)
        values = new


def scc_distributed(edges: DataFrame) -> DataFrame:
    """``(key, component)`` of all end points of ``edges(src, dst)``, without gathering the graph."""
    left = stored(edges.select("src", "dst").where("src != dst").distinct(), "graph")
    done = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    found: list[DataFrame] = []
    while not left.isEmpty():
        n = left.count()
        while True:  # trim
            inner = left.select(F.col("src").alias("k")).distinct().join(left.select(F.col("dst").alias("k")).distinct(), "k", "left_semi")
            left = stored(left.join(inner.withColumnRenamed("k", "src"), "src", "left_semi").join(inner.withColumnRenamed("k", "dst"), "dst", "left_semi"), "graph")
            if (m := left.count()) == n:
                break
            n = m
        if n == 0:
            break
        keys = left.select(F.col("src").alias("key")).distinct()
        colour = _spread(left, keys.withColumn("v", F.col("key")))
        own = left.join(colour.select(F.col("key").alias("src"), F.col("v").alias("a")), "src").join(colour.select(F.col("key").alias("dst"), F.col("v").alias("b")), "dst").where("a = b")
        back = stored(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a"), "back")
        seeds = colour.where("key = v")
        member = _reached(back, seeds.select("key", F.col("v").alias("a")))
        found.append(member.select("key", F.col("a").alias("c")))
        gone = member.select("key")
        left = stored(left.join(gone.withColumnRenamed("key", "src"), "src", "left_anti").join(gone.withColumnRenamed("key", "dst"), "dst", "left_anti"), "graph")
    groups = None
    for f in found:
        groups = f if groups is None else groups.union(f)
    if groups is None:
        return done.select("key", F.col("key").alias("component"))
    least = groups.groupBy("c").agg(F.min("key").alias("component"))
    named = groups.join(least, "c").select("key", "component")
    return done.join(named, "key", "left").select("key", F.coalesce("component", "key").alias("component"))


def _reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Keys reached from the seed of their own colour ``a`` over ``edges(src, dst, a)``."""
    all_, front = stored(seeds, "reached"), seeds
    while True:
        step = edges.join(front.withColumnRenamed("key", "src"), ["src", "a"]).select(F.col("dst").alias("key"), "a").distinct()
        front = stored(step.join(all_, ["key", "a"], "left_anti"), "front")
        if front.isEmpty():
            return all_
        all_ = stored(all_.select("key", "a").union(front.select("key", "a")), "reached")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(key, component)`` for all end points of ``edges(src, dst)``."""
    e = edges.select("src", "dst")
    few = e.limit(local_edges + 1).toArrow() if local_edges else None
    if few is not None and few.num_rows <= local_edges:
        keys, label = scc_arrays(few.column("src").to_numpy(), few.column("dst").to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"key": pa.array(keys, pa.int64()), "component": pa.array(label, pa.int64())}))
    return scc_distributed(e)


class BoxGraph:
    """The graph of a transfer operator on one grid: an edge per pair of cells with a hit."""

    def __init__(self, transfer, local_edges: int = LOCAL_EDGES):
        if transfer.domain.partition != transfer.codomain.partition:
            raise ValueError("domain and codomain are on different grids")
        self.transfer, self.partition, self.local_edges = transfer, transfer.domain.partition, local_edges

    @classmethod
    def from_boxmap(cls, box_map, cells: BoxSet) -> BoxGraph:
        from .transfer import TransferOperator

        return cls(TransferOperator(box_map, cells, cells))

    def adjacency(self) -> DataFrame:
        return self.transfer.edges.select("src", "dst", "weight")

    def strongly_connected_components(self) -> DataFrame:
        """``(key, component)`` for every domain cell; cells without edges are their own component."""
        found = components(self.transfer.edges, self.local_edges)
        return self.transfer.domain.df.join(found, "key", "left").select("key", F.coalesce("component", "key").alias("component"))

    def recurrent(self) -> DataFrame:
        """``(key, component)`` of cells in a component of several cells or with an edge to themselves."""
        parts = self.strongly_connected_components()
        loops = self.transfer.edges.where("src = dst").select(F.col("src").alias("component"), F.lit(True).alias("loop"))
        sizes = parts.groupBy("component").agg(F.count("*").alias("n")).join(loops, "component", "left")
        return parts.join(sizes.where("n > 1 or loop").select("component"), "component", "left_semi").select("key", "component")

    def recurrent_set(self) -> BoxSet:
        return BoxSet(self.partition, self.recurrent().select("key"))

    union_strongly_connected_components = recurrent_set

    def tiles(self) -> BoxMeasure:
        """Recurrent cells labelled 1, 2, ... in the order of their components' smallest keys."""
        cells = self.recurrent()
        names = numbered(cells.select("component").distinct(), "component", "n", 4).select("component", (F.col("n") + 1).cast("double").alias("weight"))
        return BoxMeasure(self.partition, cells.join(names, "component").select("key", "weight"))
