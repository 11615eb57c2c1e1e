"""Eigenpairs and singular pairs of transfer operators.

Small matrices are solved densely on the driver, up to a checked number of cells; edges that fit the driver, up to a
checked number, by restarted Arnoldi on compressed arrays; everything beyond by block subspace iteration whose
products are joins and sums, with only k x k matrices on the driver. Vectors are real parts with the entry of largest
magnitude positive, pairs come sorted by falling magnitude.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import discard, stored
from .measure import BoxMeasure, from_arrays

DENSE_CELLS = 1500
DRIVER_EDGES = 4_000_000
#: Vectors beyond the wanted ones in distributed block iteration.
GUARD = 4


def _signed(v: np.ndarray) -> np.ndarray:
    v = np.real(v)
    return -v if len(v) and v[np.argmax(np.abs(v))] < 0 else v


class _Matrix:
    """A square or rectangular sparse matrix in arrays: ``M[dst, src] = weight``."""

    def __init__(self, transfer, rows: np.ndarray, cols: np.ndarray, limit: int):
        e = transfer.edges.select("src", "dst", "weight").limit(limit + 1).toArrow()
        if e.num_rows > limit:
            raise OverflowError
        src, dst, self.w = (e.column(c).to_numpy() for c in ("src", "dst", "weight"))
        self.rows, self.cols = rows, cols
        self.i, self.j = np.searchsorted(rows, dst), np.searchsorted(cols, src)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, self.w * x[self.j].real, len(self.rows)) + (1j * np.bincount(self.i, self.w * x[self.j].imag, len(self.rows)) if np.iscomplexobj(x) else 0)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.j, self.w * y[self.i], len(self.cols))

    def dense(self) -> np.ndarray:
        m = np.zeros((len(self.rows), len(self.cols)))
        np.add.at(m, (self.i, self.j), self.w)
        return m


def _order(values: np.ndarray, which: str) -> np.ndarray:
    key = {"LM": -np.abs(values), "SM": np.abs(values), "LR": -values.real, "SR": values.real}
    if which not in key:
        raise ValueError(f"unknown selection {which!r}: LM, SM, LR or SR")
    return np.argsort(key[which], kind="stable")


def _arnoldi(m: _Matrix, k: int, which: str, size: int, v0: np.ndarray | None = None, restarts: int = 60, tol: float = 1e-10):
    """Explicitly restarted Arnoldi from a given vector, or from the vector of ones."""
    n = len(m.cols)
    size = min(n, max(size, 2 * k + 20))
    v = np.ones(n) / np.sqrt(n) if v0 is None else v0 / np.linalg.norm(v0)
    for _ in range(restarts):
        q, h = np.zeros((n, size + 1)), np.zeros((size + 1, size))
        q[:, 0] = v
        for j in range(size):
            w = m @ q[:, j]
            for _ in range(2):
                c = q[:, : j + 1].T @ w
                h[: j + 1, j] += c
                w = w - q[:, : j + 1] @ c
            h[j + 1, j] = np.linalg.norm(w)
            if h[j + 1, j] < 1e-14:
                break
            q[:, j + 1] = w / h[j + 1, j]
        used = j + 1
        values, s = np.linalg.eig(h[:used, :used])
        pick = _order(values, which)[:k]
        vectors = q[:, :used] @ s[:, pick]
        if used < size or np.all(np.abs(h[used, used - 1] * s[used - 1, pick]) <= tol * np.maximum(np.abs(values[pick]), 1e-8)):
            break
        v = np.real(vectors).sum(axis=1)
        v /= np.linalg.norm(v)
    else:
        warnings.warn(f"eigenvalues did not converge in {restarts} restarts", RuntimeWarning, stacklevel=2)
    return values[pick], vectors


def eigs(transfer, k: int = 3, which: str = "LM", v0: BoxMeasure | None = None, tol: float | None = None) -> tuple[np.ndarray, list[BoxMeasure]]:
    """Up to ``k`` eigenvalues (complex) and eigenvectors as measures on the domain.

    ``v0``: where iterations start, not 0 on the domain; ones if not given. ``tol``: relative change or residual at which they end.
    Dense matrices are solved in one go and need neither.
    """
    if transfer.domain.partition != transfer.codomain.partition:
        raise ValueError("eigenvalues need domain and codomain on one grid")
    _order(np.zeros(1), which)
    if v0 is not None and v0.partition != transfer.domain.partition:
        raise ValueError("the first vector is on another grid")
    spark, p = transfer.edges.sparkSession, transfer.domain.partition
    keys = transfer.domain.df.limit(DRIVER_EDGES + 1).toArrow().column("key").to_numpy()
    if len(keys) <= DRIVER_EDGES:
        keys = np.sort(keys)
        if len(keys) == 0:
            return np.zeros(0, complex), []
        square = transfer.edges.join(transfer.domain.df.withColumnRenamed("key", "dst"), "dst", "left_semi")
        try:
            m = _Matrix(_Edges(square), keys, keys, DRIVER_EDGES)
        except OverflowError:
            m = None
        if m is not None:
            if len(keys) <= DENSE_CELLS:
                values, vectors = np.linalg.eig(m.dense())
                pick = _order(values, which)[:k]
                values, vectors = values[pick], vectors[:, pick]
            else:
                first = None
                if v0 is not None:
                    given = v0.df.join(transfer.domain.df, "key", "left_semi").toArrow()
                    first = np.zeros(len(keys))
                    first[np.searchsorted(keys, given.column("key").to_numpy())] = given.column("weight").to_numpy()
                    if not np.any(first):
                        raise ValueError("the first vector is 0 on the domain")
                values, vectors = _arnoldi(m, k, which, 40, first, **({} if tol is None else {"tol": tol}))
            return values, [from_arrays(spark, p, keys, _signed(vectors[:, i])) for i in range(len(values))]
    if which != "LM":
        raise ValueError("matrices beyond the driver give eigenvalues of largest magnitude only")
    return subspace_iteration(transfer, k, v0=v0, **({} if tol is None else {"tol": tol}))


class _Edges:
    def __init__(self, edges: DataFrame):
        self.edges = edges


def _product(edges: DataFrame, block: DataFrame, names: list[str], source: str, target: str, cells: DataFrame) -> DataFrame:
    """A block of vectors times the matrix (or its transpose), for every one of ``cells``."""
    image = edges.join(block.withColumnRenamed("key", source), source).groupBy(F.col(target).alias("key")).agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in names])
    return cells.join(image, "key", "left").select("key", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in names])


def _iterate(cells: DataFrame, multiply, k: int, rounds: int, tol: float, v0: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Distributed block iteration with guard vectors: up to ``k`` eigenvalues by falling magnitude, their vectors, and the basis these refer to.

    Directions that the matrix takes to zero leave the block. A warning says if ``rounds`` are over before the values settle.
    """
    names = [f"v{i}" for i in range(min(k + GUARD, cells.count()))]
    first = F.lit(1.0)
    if v0 is not None:
        cells, first = cells.join(v0.select("key", F.col("weight").alias("given")), "key", "left"), F.coalesce("given", F.lit(0.0))
    start = [first.alias("v0"), *[(F.pmod(F.xxhash64("key", F.lit(i)), F.lit(1000003)) / F.lit(1000003.0) - F.lit(0.5)).alias(f"v{i}") for i in range(1, len(names))]]
    block, last = stored(cells.select("key", *start), "block"), np.zeros(0)
    for _ in range(rounds):
        q, names = _orthonormal(block, names)
        image = stored(multiply(q, names), "block")
        both = q.join(image.select("key", *[F.col(v).alias("a" + v) for v in names]), "key")
        row = both.agg(*[F.sum(F.col(a) * F.col("a" + b)).alias(f"{a}_{b}") for a in names for b in names]).first()
        values, s = np.linalg.eig(np.array([[row[f"{a}_{b}"] for b in names] for a in names]))
        order = np.argsort(-np.abs(values), kind="stable")[:k]
        values, s = values[order], s[:, order]
        discard(block)
        block = image
        if len(last) == len(values) and np.all(np.abs(values - last) <= tol * np.maximum(np.abs(values), 1e-8)):
            break
        last = values
    else:
        warnings.warn(f"eigenvalues did not converge in {rounds} rounds", RuntimeWarning, stacklevel=3)
    return values, s, q


def _combined(q: DataFrame, weights: np.ndarray) -> DataFrame:
    v = sum((F.col(f"v{j}") * F.lit(float(c)) for j, c in enumerate(np.real(weights))), F.lit(0.0))
    return q.select("key", v.alias("weight"))


def subspace_iteration(transfer, k: int = 3, rounds: int = 1000, tol: float = 1e-8, v0: BoxMeasure | None = None) -> tuple[np.ndarray, list[BoxMeasure]]:
    """Eigenpairs without gathering the matrix: products are joins and sums, only k x k matrices reach the driver."""
    cells = transfer.domain.df
    values, s, q = _iterate(cells, lambda b, names: _product(transfer.edges, b, names, "src", "dst", cells), k, rounds, tol, None if v0 is None else v0.df)
    return values, [BoxMeasure(transfer.domain.partition, _combined(q, s[:, i])) for i in range(len(values))]


def svds_distributed(transfer, k: int = 3, rounds: int = 1000, tol: float = 1e-10) -> tuple[list[BoxMeasure], np.ndarray, list[BoxMeasure]]:
    """Singular pairs by block iteration on the matrix times its transpose."""
    rows, cols, e = transfer.codomain.df, transfer.domain.df, transfer.edges
    values, s, q = _iterate(cols, lambda b, names: _product(e, _product(e, b, names, "src", "dst", rows), names, "dst", "src", cols), k, rounds, tol)
    sigma = np.sqrt(np.maximum(np.real(values), 0.0))
    right = [BoxMeasure(transfer.domain.partition, _combined(q, s[:, i])) for i in range(len(values))]
    left = [transfer.push_forward(v) / float(x) if x > 0 else transfer.push_forward(v) for v, x in zip(right, sigma, strict=True)]
    return left, sigma, right


def _orthonormal(block: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    row = block.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in names]).first()
    gram = np.array([[row[f"{a}_{b}"] for b in names] for a in names])
    d, u = np.linalg.eigh(gram)
    keep = d > 1e-13 * d.max()
    keep[-1] = True
    t = u[:, keep] / np.sqrt(np.maximum(d[keep], 1e-300))
    basis = [sum((F.col(a) * F.lit(float(t[j, i])) for j, a in enumerate(names)), F.lit(0.0)).alias(names[i]) for i in range(t.shape[1])]
    return stored(block.select("key", *basis), "basis"), names[: t.shape[1]]


def _largest(n: int, times, k: int, tol: float = 1e-9, cycles: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenpairs of a symmetric operator without negative ones, repeated eigenvalues included.

    Block Lanczos with full reorthogonalisation, restarted with the best vectors until the residuals are below ``tol``
    times the largest eigenvalue; a block has more vectors than ``k``, so that copies of an eigenvalue are not missed.
    """
    b = min(n, k + 4)
    size = min(n, max(4 * b, 60))
    q, t, used = np.zeros((n, size)), np.zeros((size, size)), 0
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((n, b)))[0]
    for _ in range(cycles):
        while True:
            at, used = used, used + block.shape[1]
            q[:, at:used] = block
            x = np.stack([times(y) for y in block.T], axis=1)
            t[:used, at:used] = q[:, :used].T @ x
            for _ in range(2):
                x = x - q[:, :used] @ (q[:, :used].T @ x)
            block, c, r = np.linalg.svd(x, full_matrices=False)
            new = c > 1e-11 * np.abs(t[:used, :used]).max()
            block, rest = block[:, new], c[new, None] * r[new]
            block = np.linalg.qr(block - q[:, :used] @ (q[:, :used].T @ block))[0]
            if not 0 < block.shape[1] <= size - used:
                break
        upper = np.triu(t[:used, :used])
        d, w = np.linalg.eigh(upper + np.triu(upper, 1).T)
        d, w = d[::-1], w[:, ::-1]
        if block.shape[1] == 0 or np.all(np.linalg.norm(rest @ w[at:used, :k], axis=0) <= tol * max(d[0], 1e-300)):
            return d[:k], q[:, :used] @ w[:, :k]
        keep = min(used, (size - b) // 2 + k // 2, size - block.shape[1])
        q[:, :keep] = q[:, :used] @ w[:, :keep]
        t[:], used = 0.0, keep
        t[:keep, :keep] = np.diag(d[:keep])
    raise ArithmeticError(f"{k} singular values did not converge in {cycles} cycles")


def svds(transfer, k: int = 3) -> tuple[list[BoxMeasure], np.ndarray, list[BoxMeasure]]:
    """Left vectors (codomain), singular values in falling order, right vectors (domain)."""
    spark = transfer.edges.sparkSession
    cols, rows = (np.sort(c.df.limit(DRIVER_EDGES + 1).toArrow().column("key").to_numpy()) for c in (transfer.domain, transfer.codomain))
    try:
        m = _Matrix(transfer, rows, cols, DRIVER_EDGES if max(len(rows), len(cols)) <= DRIVER_EDGES else 0)
    except OverflowError:
        return svds_distributed(transfer, k)
    if max(len(rows), len(cols)) <= DENSE_CELLS:
        u, s, vt = np.linalg.svd(m.dense(), full_matrices=False)
        u, s, v = u[:, :k], s[:k], vt[:k].T
    else:
        v = _largest(len(cols), lambda x: m.transposed(m @ x), min(k, len(rows), len(cols)))[1]
        u, s, z = np.linalg.svd(np.stack([m @ x for x in v.T], axis=1), full_matrices=False)
        v = v @ z.T
    left, right = [], []
    for i in range(len(s)):
        sign = 1.0 if len(v) == 0 or v[np.argmax(np.abs(v[:, i])), i] >= 0 else -1.0
        left.append(from_arrays(spark, transfer.codomain.partition, rows, sign * u[:, i]))
        right.append(from_arrays(spark, transfer.domain.partition, cols, sign * v[:, i]))
    return left, s, right
