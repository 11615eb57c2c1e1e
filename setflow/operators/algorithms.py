"""Iterative set algorithms: attractors, unstable sets, invariant sets, chain recurrence, Lyapunov exponents.

Every step is one plan over the last step's set; the driver holds the grid's metadata. A set of more than ``LOCAL_CELLS``
cells is a stored table, a smaller one a list of keys on the driver (8 bytes each), which saves a table per step.
A batch map's first steps, as long as they have few test points, run in NumPy on the driver: the same code that
runs in the tasks, without a job per step.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BoxPartition
from ..sources.durable import discard, stored
from .boxset import BoxSet, key_frame
from .graph import BoxGraph
from .maps import BatchMap, BoxMap, ColumnMap
from .measure import BoxMeasure
from .transfer import TransferOperator

#: Steps of a batch map with at most so many test points need no job.
LOCAL_POINTS = 1 << 19
LOCAL_CELLS = 1 << 16


def _small(cells: BoxSet, box_map: BoxMap, steps: int) -> tuple[BoxSet, int]:
    """Take as many attractor steps as are small on the driver: the set reached and the steps left."""
    if not isinstance(box_map, BatchMap) or steps == 0:
        return cells, steps
    first = cells.df.limit(LOCAL_CELLS + 1).toArrow()
    if first.num_rows > LOCAL_CELLS:
        return cells, steps
    p, keys, taken = cells.partition, np.sort(first.column("key").to_numpy()), 0
    while steps and 2 * len(keys) <= LOCAL_CELLS and 2 * len(keys) * box_map.n_test_points <= LOCAL_POINTS:
        dim = p.next_dim()
        s, fine = p.strides[dim], p.subdivide(dim)
        low = (keys // s) * 2 * s + keys % s
        keys = np.sort(np.concatenate([low, low + s]))
        hit = [dst for _, dst, _ in box_map.hit_keys(fine, fine, keys)]
        keys = np.intersect1d(keys, np.unique(np.concatenate(hit))) if hit else keys[:0]
        p, steps, taken = fine, steps - 1, taken + 1
    return (BoxSet(p, key_frame(cells.df.sparkSession, keys)), steps) if taken else (cells, steps)


def _settled(cells: BoxSet, few: bool, most: int | None = None) -> tuple[BoxSet, int | None]:
    """A set computed once: where it may have few cells as keys on the driver, with their number, else as a stored table.

    ``most``: how many cells it can have, if that is known.
    """
    if few:
        bounded = most is not None and most <= LOCAL_CELLS
        first = (cells.df if bounded else cells.df.limit(LOCAL_CELLS + 1)).toArrow()
        if first.num_rows <= LOCAL_CELLS:
            return BoxSet(cells.partition, key_frame(cells.df.sparkSession, first.column("key").to_numpy())), first.num_rows
    return cells.stored(), None


def relative_attractor(box_map: BoxMap, cells: BoxSet, steps: int = 12) -> BoxSet:
    """Refine, then keep the cells that are hit from the set itself; ``steps`` times, even if the set becomes empty."""
    cells, steps = _small(cells, box_map, steps)
    return _refined(cells, steps, lambda fine, few: BoxSet(fine.partition, box_map.image(fine).df.join(_beside(fine, few), "key", "left_semi")) if few else fine & box_map.image(fine))


def _beside(cells: BoxSet, few: bool) -> DataFrame:
    """Cells for the side of a join: broadcast where there are at most ``LOCAL_CELLS``."""
    return F.broadcast(cells.df) if few else cells.df


def _refined(cells: BoxSet, steps: int, keep) -> BoxSet:
    """``steps`` times refine and keep a part; each step's set replaces the one before."""
    if steps == 0:
        return cells
    old, (cells, n) = None, _settled(cells, not hasattr(cells.df, "_stored_at"))
    for _ in range(steps):
        few = n is not None and 2 * n <= LOCAL_CELLS
        cells, n = _settled(keep(cells.refine(), few), few, 2 * n if few else None)
        if old is not None:
            discard(old)
        old = cells.df
    return cells


#: Fronts of an unstable set that are kept apart before they become one table.
FRONTS = 16


def unstable_set(box_map: BoxMap, seed: BoxSet, max_iter: int | None = None) -> BoxSet:
    """All cells reached from the seed; each round maps only the cells that the last one added."""
    front, n = _settled(seed, True)
    parts, done = [front.df], 0
    while n != 0 and (max_iter is None or done < max_iter):
        known = BoxSet(seed.partition, reduce(DataFrame.union, parts))
        front, n = _settled(box_map.image(front) - known, n is not None)
        if n is None and front.is_empty():
            break
        parts, done = [*parts, front.df], done + 1
        if len(parts) > FRONTS:
            parts = [stored(reduce(DataFrame.union, parts), "reached")]
    return BoxSet(seed.partition, reduce(DataFrame.union, parts))


def preimage(box_map: BoxMap, cells: BoxSet, among: BoxSet, few: bool = False) -> BoxSet:
    """Cells of ``among`` with a hit in ``cells``: a semi join, no matrix. ``few``: there are at most ``LOCAL_CELLS`` of them."""
    pairs = box_map.counted(among, cells.partition).join(_beside(cells, few).withColumnRenamed("key", "dst"), "dst", "left_semi")
    return BoxSet(among.partition, pairs.select(F.col("src").alias("key")).distinct())


def alpha_limit_set(box_map: BoxMap, cells: BoxSet, steps: int = 12) -> BoxSet:
    """Refine, then keep the cells whose image meets the set."""
    return _refined(cells, steps, lambda fine, few: preimage(box_map, fine, fine, few))


def maximal_invariant_set(box_map: BoxMap, cells: BoxSet, steps: int = 12) -> BoxSet:
    """Refine, then keep the cells that are hit from the set and whose image meets it; the map is applied once a step."""

    def keep(fine: BoxSet, few: bool) -> BoxSet:
        pairs = stored(box_map.counted(fine).select("src", "dst").join(_beside(fine, few).withColumnRenamed("key", "dst"), "dst", "left_semi"), "pairs")
        hit, source = pairs.select(F.col("dst").alias("key")).distinct(), pairs.select(F.col("src").alias("key")).distinct()
        both, _ = _settled(BoxSet(fine.partition, hit.join(source, "key", "left_semi")), True)
        discard(pairs)
        return both

    return _refined(cells, steps, keep)


def morse_sets(box_map: BoxMap, cells: BoxSet) -> BoxSet:
    return BoxGraph.from_boxmap(box_map, cells).recurrent_set()


def morse_tiles(box_map: BoxMap, cells: BoxSet) -> BoxMeasure:
    return BoxGraph.from_boxmap(box_map, cells).tiles()


def recurrent_set(box_map: BoxMap, cells: BoxSet, steps: int = 12) -> BoxSet:
    """Refine, then keep the recurrent cells; an empty set is returned as it is."""
    cells, n = _settled(cells, True)
    for _ in range(steps):
        if n == 0 or (n is None and cells.is_empty()):
            break
        few = n is not None and 2 * n <= LOCAL_CELLS
        cells, n = _settled(morse_sets(box_map, cells.refine()), few, 2 * n if few else None)
    return cells


def finite_time_lyapunov_exponents(box_map: BoxMap, cells: BoxSet, span: float, delta: float | None = None) -> BoxMeasure:
    """``log(largest singular value of the Jacobian at the center) / span``, by forward differences.

    Column maps of one or two dimensions use the closed form of the singular value, of more LAPACK on Arrow batches of
    Jacobians; batch maps make the points of a stencil in the batch that uses them.
    """
    p, n = cells.partition, cells.partition.ndim
    delta = float(np.min(p.cell_radius)) * 0.01 if delta is None else float(delta)
    if isinstance(box_map, ColumnMap):
        xs = [F.col(f"x{d}") for d in range(n)]
        rows = cells.centers().select("key", *[y.alias(f"f{d}") for d, y in enumerate(box_map.at(xs))], *[y.alias(f"g{i}{d}") for i in range(n) for d, y in enumerate(box_map.at([x + F.lit(delta) if i == k else x for k, x in enumerate(xs)]))])
        j = [[(F.col(f"g{i}{d}") - F.col(f"f{d}")) / F.lit(delta) for i in range(n)] for d in range(n)]
        if n > 2:
            return BoxMeasure(p, rows.select("key", F.array(*[x for row in j for x in row]).alias("j")).mapInArrow(_largest_stretch(n, span), "key long, weight double"))
        if n == 1:
            sigma = F.abs(j[0][0])
        else:
            (a, b), (c, d) = j
            s, det = a * a + b * b + c * c + d * d, a * d - b * c
            sigma = F.sqrt((s + F.sqrt(F.greatest(s * s - F.lit(4.0) * det * det, F.lit(0.0)))) / F.lit(2.0))
        return BoxMeasure(p, rows.select("key", (F.log(F.greatest(sigma, F.lit(1e-15))) / F.lit(float(span))).alias("weight")))
    return BoxMeasure(p, cells.df.mapInArrow(_ftle(box_map, p, span, delta, False), "key long, weight double"))


def _largest_stretch(n: int, span: float):
    """Batches of (key, Jacobian row by row) to the exponent of the largest singular value."""

    def run(batches):
        for b in batches:
            m = np.asarray(b.column(1).flatten()).reshape(-1, n, n)
            sigma = np.linalg.svd(m, compute_uv=False)[:, 0] if len(m) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.log(np.maximum(sigma, 1e-15)) / span)], ["key", "weight"])

    return run


def _ftle(box_map: BatchMap, p: BoxPartition, span: float, delta: float, framed: bool, times=None):
    n = p.ndim

    def run(batches):
        for b in batches:
            keys = b.column(b.num_columns - 1).to_numpy()
            for at in range(0, len(keys), 1 << 15):
                k = keys[at : at + (1 << 15)]
                c = p.centers_batch(k)
                stencil = np.concatenate([c, *[c + delta * np.eye(n)[i] for i in range(n)]])
                t0 = np.tile(times[b.column(0).to_numpy()[at : at + (1 << 15)]], n + 1) if framed else None
                y = box_map.apply(stencil, t0).reshape(n + 1, len(k), n)
                jacobian = np.moveaxis((y[1:] - y[0]) / delta, 0, 2)
                sigma = np.linalg.svd(jacobian, compute_uv=False)[:, 0] if len(k) else np.empty(0)
                weight = pa.array(np.log(np.maximum(sigma, 1e-15)) / span)
                first = [b.column(0).slice(at, len(k))] if framed else []
                yield pa.RecordBatch.from_arrays([*first, pa.array(k), weight], [*(["frame"] if framed else []), "key", "weight"])

    return run


def ftle_frames(box_map, cells: BoxSet, span: float, times, delta: float | None = None) -> DataFrame:
    """``(frame, key, weight)`` for all start times of a nonautonomous map in one job."""
    p = cells.partition
    delta = float(np.min(p.cell_radius)) * 0.01 if delta is None else float(delta)
    times = np.asarray(times, float)
    rows = cells.df.select(F.explode(F.sequence(F.lit(0), F.lit(len(times) - 1))).alias("frame"), "key")
    return rows.mapInArrow(_ftle(box_map, p, span, delta, True, times), "frame int, key long, weight double")


def invariant_measure(transfer: TransferOperator, steps: int) -> BoxMeasure:
    """``steps`` rounds of push-forward from the uniform probability measure."""
    n = transfer.domain.count()
    mu = BoxMeasure.uniform(transfer.domain, 1.0 / n)
    for k in range(steps):
        mu = transfer.push_forward(mu)
        if k % 5 == 4:
            mu = mu.stored()
    return mu
