"""Maps and vector fields used as workloads. Column maps take and return columns; batch fields take ``(N, n)`` arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

# Column maps: usable wherever columns are, compiled with the rest of the stage.


def identity(*x):
    return list(x)


def scaled(a: float):
    return lambda *x: [F.lit(float(a)) * v for v in x]


def square(*x):
    return [v * v for v in x]


def half_y(x, y):
    return [x, y * F.lit(0.5)]


def shift_x(x, y):
    return [x + F.lit(1.0), y]


def henon(x, y, a: float = 1.4, b: float = 0.3):
    return [F.lit(1.0) - F.lit(a) * (x * x) + y, F.lit(b) * x]


def lozi(x, y, a: float = 1.7, b: float = 0.5):
    return [F.lit(1.0) - F.lit(a) * F.abs(x) + y, F.lit(b) * x]


def ikeda(x, y, mu: float = 0.9):
    t = F.lit(0.4) - F.lit(6.0) / (F.lit(1.0) + x * x + y * y)
    c, s = F.cos(t), F.sin(t)
    return [F.lit(1.0) + F.lit(mu) * (x * c - y * s), F.lit(mu) * (x * s + y * c)]


def logistic(x, mu: float = 4.0):
    return [F.lit(mu) * x * (F.lit(1.0) - x)]


def doubling(x):
    return [F.lit(2.0) * x]


def baker(x, y):
    left = x < F.lit(0.5)
    return [F.when(left, F.lit(2.0) * x).otherwise(F.lit(2.0) * x - F.lit(1.0)), F.when(left, y / F.lit(2.0)).otherwise(y / F.lit(2.0) + F.lit(0.5))]


# Vector fields on batches


def _columns(*parts: np.ndarray) -> np.ndarray:
    """An ``(N, n)`` array whose columns lie in one piece, so that fields read them fast."""
    return np.array(parts).T


def four_wing(p: np.ndarray, a: float = 0.2, b: float = -0.01, d: float = -0.4) -> np.ndarray:
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    out = np.empty((3, len(p)))
    np.multiply(x, a, out=out[0])
    out[0] += y * z
    np.multiply(y, d, out=out[1])
    out[1] += b * x
    out[1] -= z * y
    np.negative(z, out=out[2])
    out[2] -= x * y
    return out.T


def lorenz(p: np.ndarray, sigma: float = 10.0, rho: float = 28.0, beta: float = 0.4) -> np.ndarray:
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    return _columns(sigma * (y - x), rho * x - y - x * z, x * y - beta * z)


def chua(p: np.ndarray, a: float = 16.0, b: float = 33.0, m0: float = -0.2, m1: float = 0.01) -> np.ndarray:
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    return _columns(a * (y - m0 * x - m1 / 3.0 * x**3), x - y + z, -b * y)


def double_gyre(p: np.ndarray, t, amp: float = 0.25, eps: float = 0.25, omega: float = 2.0 * np.pi) -> np.ndarray:
    """Nonautonomous; ``t`` is a number or one time per point."""
    x, y = p[:, 0], p[:, 1]
    s = eps * np.sin(omega * np.asarray(t, float))
    fx, dfdx = s * x * x + (1.0 - 2.0 * s) * x, 2.0 * s * x + (1.0 - 2.0 * s)
    return _columns(-np.pi * amp * np.sin(np.pi * fx) * np.cos(np.pi * y), np.pi * amp * np.cos(np.pi * fx) * np.sin(np.pi * y) * dfdx)
