"""Box maps: which cells do the test points of a cell land in.

Everything rests on one subplan, ``hits(cells) -> (src, dst)``, a row per test point that lands in the domain.
A ``ColumnMap`` is a projection that Spark compiles together with the key arithmetic around it; a ``BatchMap``
runs a NumPy function on Arrow batches, keys in and keys out, so points never cross between JVM and Python.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, BoxPartition
from ..functions.ode import rk4_tspan
from .boxset import BoxSet

#: Test points that a batch map evaluates at once: their arrays stay in the cache.
POINTS_AT_ONCE = 1 << 12


def grid_points(ndim: int, n: int | Sequence[int] = 4) -> np.ndarray:
    """Left-aligned grid of ``n`` points per axis in [-1, 1)^ndim."""
    counts = [int(n)] * ndim if np.isscalar(n) else [int(k) for k in n]
    if len(counts) != ndim or any(k < 1 for k in counts):
        raise ValueError("one count of at least 1 per dimension")
    return np.array(list(itertools.product(*[[-1.0 + k * 2.0 / m for k in range(m)] for m in counts])))


def lattice(ndim: int, lo: float, hi: float, n: int) -> np.ndarray:
    """``n`` evenly spaced points per axis from ``lo`` to ``hi``, both included."""
    return np.array(list(itertools.product(np.linspace(lo, hi, n).tolist(), repeat=ndim)))


def monte_carlo_points(ndim: int, n: int | None = None, seed: int | None = None) -> np.ndarray:
    """``n`` uniform points, drawn once on the driver so that all cells share them."""
    return np.random.default_rng(seed).uniform(-1.0, 1.0, (16 * ndim if n is None else n, ndim))


class BoxMap:
    """A map with a domain and unit test points; subclasses provide ``hits``."""

    def __init__(self, f: Callable, domain: Box, unit_points: np.ndarray):
        u = np.asarray(unit_points, float)
        if u.ndim != 2:
            raise ValueError("unit points must be a two-dimensional array")
        if u.shape[1] != domain.ndim:
            raise ValueError(f"unit points have {u.shape[1]} coordinates, the domain {domain.ndim}")
        self.f, self.domain, self.unit_points = f, domain, u

    @property
    def n_test_points(self) -> int:
        return len(self.unit_points)

    @property
    def ndim(self) -> int:
        return self.domain.ndim

    def hits(self, cells: BoxSet, target: BoxPartition | None = None) -> DataFrame:
        """``(src, dst)``: a row per test point that lands in ``target`` (by default the cells' own grid)."""
        raise NotImplementedError

    def counted(self, cells: BoxSet, target: BoxPartition | None = None) -> DataFrame:
        """``(src, dst, hits)``: hits summed per pair of cells."""
        return self.hits(cells, target).groupBy("src", "dst").agg(F.count("*").alias("hits"))

    def image(self, cells: BoxSet) -> BoxSet:
        """Cells that are hit; one shuffle, of keys already made distinct in each task."""
        return BoxSet(cells.partition, self.hits(cells).select(F.col("dst").alias("key")).distinct())

    map_boxes = __call__ = image

    def __repr__(self) -> str:
        return f"{type(self).__name__}(domain={self.domain!r}, n_test_points={self.n_test_points})"


class ColumnMap(BoxMap):
    """``f`` takes n columns and returns n columns."""

    def images(self, cells: BoxSet) -> DataFrame:
        """``src, y0, y1, ...``: the images of all test points."""
        p, n = cells.partition, self.ndim
        units = F.array(*[F.struct(*[F.lit(float(v)).alias(f"u{d}") for d, v in enumerate(u)]) for u in self.unit_points])
        rows = cells.df.select(F.col("key").alias("src"), *[c.alias(f"c{d}") for d, c in enumerate(p.center_exprs(F.col("key")))])
        rows = rows.select("*", F.explode(units).alias("u"))
        r = p.cell_radius.tolist()
        points = rows.select("src", *[(F.col(f"c{d}") + F.col(f"u.u{d}") * F.lit(r[d])).alias(f"x{d}") for d in range(n)])
        return points.select("src", *[y.alias(f"y{d}") for d, y in enumerate(self.f(*[F.col(f"x{d}") for d in range(n)]))])

    def hits(self, cells: BoxSet, target: BoxPartition | None = None) -> DataFrame:
        target = target or cells.partition
        ys = [F.col(f"y{d}") for d in range(self.ndim)]
        return self.images(cells).where(target.in_domain(ys)).select("src", target.key_expr(ys).alias("dst"))

    def at(self, cols: Sequence[Column]) -> list[Column]:
        return list(self.f(*cols))


class BatchMap(BoxMap):
    """``f`` takes an ``(N, n)`` array and returns one."""

    def apply(self, points: np.ndarray, t0: np.ndarray | None = None) -> np.ndarray:
        return np.asarray(self.f(points), float)

    def hit_keys(self, partition: BoxPartition, target: BoxPartition, keys: np.ndarray, t0=None):
        """Pieces ``(src, dst, hits)`` for some keys, pairs already summed."""
        step = max(1, POINTS_AT_ONCE // self.n_test_points)
        r = partition.cell_radius
        for at in range(0, len(keys), step):
            part = keys[at : at + step]
            pts = (partition.centers_batch(part)[:, None, :] + self.unit_points[None] * r).reshape(-1, self.ndim)
            times = None if t0 is None else np.repeat(t0[at : at + step], self.n_test_points)
            dst = target.point_to_key_batch(self.apply(pts, times)).reshape(len(part), -1)
            dst.sort(axis=1)
            new = np.ones(dst.shape, bool)
            new[:, 1:] = dst[:, 1:] != dst[:, :-1]
            place = np.nonzero(new.ravel())[0]
            n = np.diff(np.append(place, dst.size))
            src, got = np.repeat(part, self.n_test_points)[place], dst.ravel()[place]
            yield src[got >= 0], got[got >= 0], n[got >= 0]

    def counted(self, cells: BoxSet, target: BoxPartition | None = None) -> DataFrame:
        """No shuffle: all hits of a cell are made in one batch and summed there."""
        p, target = cells.partition, target or cells.partition
        hit_keys = self.hit_keys

        def run(batches):
            for b in batches:
                for src, dst, n in hit_keys(p, target, b.column(0).to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(n.astype(np.int64))], ["src", "dst", "hits"])

        return cells.df.mapInArrow(run, "src long, dst long, hits long")

    def hits(self, cells: BoxSet, target: BoxPartition | None = None) -> DataFrame:
        return self.counted(cells, target).select("src", F.explode(F.expr("array_repeat(dst, cast(hits as int))")).alias("dst"))

    def image(self, cells: BoxSet) -> BoxSet:
        p, hit_keys = cells.partition, self.hit_keys

        def run(batches):
            for b in batches:
                for _, dst, _ in hit_keys(p, p, b.column(0).to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(dst))], ["key"])

        return BoxSet(p, cells.df.mapInArrow(run, "key long").distinct())

    map_boxes = __call__ = image


class PointMap(BatchMap):
    """``f`` takes one point; the slow way, for functions that know nothing of arrays."""

    def apply(self, points: np.ndarray, t0=None) -> np.ndarray:
        return np.array([self.f(p) for p in points], float).reshape(-1, self.ndim)


class NonautonomousMap(BatchMap):
    """Flow of ``field(points, t)`` over ``[t0, t0 + span]``."""

    def __init__(self, field: Callable, domain: Box, unit_points: np.ndarray, t0: float = 0.0, span: float = 1.0, step_size: float = 0.05):
        super().__init__(field, domain, unit_points)
        self.t0, self.span, self.step_size = float(t0), float(span), float(step_size)

    def with_t0(self, t0: float) -> NonautonomousMap:
        return type(self)(self.f, self.domain, self.unit_points, t0, self.span, self.step_size)

    def apply(self, points: np.ndarray, t0=None) -> np.ndarray:
        return rk4_tspan(self.f, points, self.t0 if t0 is None else t0, self.span, self.step_size)

    def frames(self, cells: BoxSet, times: Sequence[float], target: BoxPartition | None = None) -> DataFrame:
        """``(frame, src, dst, hits)`` for all start times in one job; frames and cells are one relation."""
        p, target, hit_keys, times = cells.partition, target or cells.partition, self.hit_keys, np.asarray(times, float)

        def run(batches):
            for b in batches:
                frame, key = b.column(0).to_numpy(), b.column(1).to_numpy()
                for k in np.unique(frame):
                    own = key[frame == k]
                    for src, dst, n in hit_keys(p, target, own, np.full(len(own), times[k])):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), k, np.int32)), pa.array(src), pa.array(dst), pa.array(n.astype(np.int64))], ["frame", "src", "dst", "hits"])

        rows = cells.df.select(F.explode(F.sequence(F.lit(0), F.lit(len(times) - 1))).alias("frame"), "key")
        return rows.mapInArrow(run, "frame int, src long, dst long, hits long")


def box_map(f: Callable, domain: Box, unit_points: np.ndarray, engine: str = "auto") -> BoxMap:
    """``engine``: column, batch, python, or auto, which tries the function on columns, then on a batch, then on a point."""
    kinds = {"column": ColumnMap, "batch": BatchMap, "python": PointMap}
    if engine in kinds:
        return kinds[engine](f, domain, unit_points)
    if engine != "auto":
        raise ValueError(f"unknown engine {engine!r}: column, batch, python or auto")
    # a function that does not know a kind of argument says so by one of these errors; any other is its own and is raised
    unknown = (TypeError, ValueError, AttributeError, IndexError, PySparkException)
    try:
        out = f(*[F.col(f"x{d}") for d in range(domain.ndim)])
        if isinstance(out, (list, tuple)) and len(out) == domain.ndim and all(isinstance(c, Column) for c in out):
            return ColumnMap(f, domain, unit_points)
    except unknown:
        pass
    probe = np.tile(np.array(domain.center), (3, 1))
    try:
        whole, one = np.asarray(f(probe), float), np.asarray(f(probe[:1]), float)
    except unknown:
        return PointMap(f, domain, unit_points)
    if whole.shape == probe.shape and np.allclose(whole[:1], one, equal_nan=True):
        return BatchMap(f, domain, unit_points)
    return PointMap(f, domain, unit_points)


def GridMap(f: Callable, domain: Box, n_points: int | Sequence[int] = 4, engine: str = "auto") -> BoxMap:
    return box_map(f, domain, grid_points(domain.ndim, n_points), engine)


def MonteCarloMap(f: Callable, domain: Box, n_points: int | None = None, seed: int | None = None, engine: str = "auto") -> BoxMap:
    return box_map(f, domain, monte_carlo_points(domain.ndim, n_points, seed), engine)
