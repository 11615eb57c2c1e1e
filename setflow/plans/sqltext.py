"""DuckDB SQL for the engine's building blocks, in the same order of floating-point operations as the columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from ..functions.geometry import BoxPartition

Map = Callable[..., list[str]]


def num(x: float) -> str:
    return f"'{float(x)!r}'::DOUBLE"


def in_domain(p: BoxPartition, cols: Sequence[str]) -> str:
    return " AND ".join(f"{c} >= {num(lo)} AND {c} < {num(hi)}" for c, lo, hi in zip(cols, p.domain.lo, p.domain.hi, strict=True))


def key_of(p: BoxPartition, cols: Sequence[str]) -> str:
    parts = [f"least(greatest(CAST(floor(({c} - {num(lo)}) / {num(2.0 * r)}) AS BIGINT), 0), {n - 1}) * {s}" for c, lo, r, n, s in zip(cols, p.domain.lo, p.cell_radius, p.dims, p.strides, strict=True)]
    return "(" + " + ".join(parts) + ")"


def multi_of(p: BoxPartition, key: str = "key") -> list[str]:
    return [f"({key} // {s}) % {n}" for s, n in zip(p.strides, p.dims, strict=True)]


def centers_of(p: BoxPartition, key: str = "key") -> list[str]:
    return [f"({num(lo)} + {num(2.0 * r)} * ({m} + 0.5))" for m, lo, r in zip(multi_of(p, key), p.domain.lo, p.cell_radius, strict=True)]


def cover(p: BoxPartition, points: str, cols: Sequence[str]) -> str:
    return f"SELECT DISTINCT {key_of(p, cols)} AS key FROM {points} WHERE {in_domain(p, cols)}"


def children(p: BoxPartition, cells: str, dim: int) -> str:
    s = p.strides[dim]
    return f"SELECT (key // {s}) * {2 * s} + b * {s} + key % {s} AS key FROM {cells}, (VALUES (0), (1)) AS bit(b)"


def units(points: np.ndarray) -> str:
    rows = ", ".join("(" + ", ".join(num(v) for v in u) + ")" for u in points)
    return f"(VALUES {rows}) AS u({', '.join(f'u{d}' for d in range(points.shape[1]))})"


def hits(p: BoxPartition, cells: str, f: Map, points: np.ndarray) -> str:
    """``src, dst``: a row per test point in the domain."""
    n = p.ndim
    x = ", ".join(f"{c} + u{d} * {num(r)} AS x{d}" for d, (c, r) in enumerate(zip(centers_of(p), p.cell_radius, strict=True)))
    y = ", ".join(f"{e} AS y{d}" for d, e in enumerate(f(*[f"x{d}" for d in range(n)])))
    ys = [f"y{d}" for d in range(n)]
    inner = f"SELECT src, {y} FROM (SELECT key AS src, {x} FROM {cells}, {units(points)}) AS pts"
    return f"SELECT src, {key_of(p, ys)} AS dst FROM ({inner}) AS img WHERE {in_domain(p, ys)}"


def edges(p: BoxPartition, cells: str, f: Map, points: np.ndarray, codomain: str | None) -> str:
    """``src, dst, hits, weight``."""
    some = f" WHERE dst IN (SELECT key FROM {codomain})" if codomain else ""
    return f"SELECT src, dst, hits, hits / total AS weight FROM (SELECT *, CAST(sum(hits) OVER (PARTITION BY src) AS DOUBLE) AS total FROM (SELECT src, dst, count(*) AS hits FROM ({hits(p, cells, f, points)}) AS h{some} GROUP BY ALL) AS g) AS t"


def refined(p: BoxPartition, seed: str, steps: int, keep: Callable[[BoxPartition, str], str]) -> tuple[str, str, BoxPartition]:
    """CTEs of a subdivision algorithm: their text, the last one's name, its grid. ``keep(p, cells)`` selects what stays."""
    text, name = f"s0 AS MATERIALIZED ({seed})", "s0"
    for k in range(1, steps + 1):
        dim = p.next_dim()
        text += f",\nc{k} AS MATERIALIZED ({children(p, name, dim)})"
        p = p.subdivide(dim)
        text += f",\ns{k} AS MATERIALIZED ({keep(p, f'c{k}')})"
        name = f"s{k}"
    return text, name, p


def attractor(p: BoxPartition, seed: str, steps: int, f: Map, points: np.ndarray) -> tuple[str, str, BoxPartition]:
    return refined(p, seed, steps, lambda q, c: f"SELECT key FROM {c} WHERE key IN (SELECT dst FROM ({hits(q, c, f, points)}) AS h)")


# Maps as SQL


def lozi(x: str, y: str) -> list[str]:
    return [f"({num(1)} - {num(1.7)} * abs({x}) + {y})", f"({num(0.5)} * {x})"]


def henon(x: str, y: str) -> list[str]:
    return [f"({num(1)} - {num(1.4)} * ({x} * {x}) + {y})", f"({num(0.3)} * {x})"]


def ikeda(x: str, y: str) -> list[str]:
    t = f"({num(0.4)} - {num(6)} / ({num(1)} + {x} * {x} + {y} * {y}))"
    return [f"({num(1)} + {num(0.9)} * ({x} * cos({t}) - {y} * sin({t})))", f"({num(0.9)} * ({x} * sin({t}) + {y} * cos({t})))"]


def half_y(x: str, y: str) -> list[str]:
    return [x, f"({y} * {num(0.5)})"]


def square(*x: str) -> list[str]:
    return [f"({v} * {v})" for v in x]


def shift_x(x: str, y: str) -> list[str]:
    return [f"({x} + {num(1)})", y]


def logistic(x: str) -> list[str]:
    return [f"({num(4)} * {x} * ({num(1)} - {x}))"]


def baker(x: str, y: str) -> list[str]:
    return [f"(CASE WHEN {x} < {num(0.5)} THEN {num(2)} * {x} ELSE {num(2)} * {x} - {num(1)} END)", f"(CASE WHEN {x} < {num(0.5)} THEN {y} / {num(2)} ELSE {y} / {num(2)} + {num(0.5)} END)"]


def scaled(a: float) -> Map:
    return lambda *x: [f"({num(a)} * {v})" for v in x]


def identity(*x: str) -> list[str]:
    return list(x)


# Flows


def rk4(points: str, keep: Sequence[str], xs: Sequence[str], t: str, field: Callable[[list[str], str], list[str]], span: float, steps: int) -> str:
    """A query of ``keep`` and ``xs``: the classical Runge-Kutta flow of ``points(keep, xs, t)``, a recursive round per step."""
    h, n = span / steps, len(xs)
    cols = ", ".join([*keep, *xs, t])
    stage = f"SELECT * FROM flow WHERE done < {steps}"
    for i, (size, part) in enumerate(((None, 0.0), (h / 2.0, h / 2.0), (h / 2.0, h / 2.0), (h, h)), 1):
        at = [x if size is None else f"({x} + {num(size)} * k{i - 1}_{d})" for d, x in enumerate(xs)]
        when = t if size is None else f"({t} + {num(part)})"
        stage = f"SELECT *, {', '.join(f'{e} AS at{i}_{d}' for d, e in enumerate(at))}, {when} AS t{i} FROM ({stage}) AS s{i}"
        stage = f"SELECT *, {', '.join(f'{e} AS k{i}_{d}' for d, e in enumerate(field([f'at{i}_{d}' for d in range(n)], f't{i}')))} FROM ({stage}) AS f{i}"
    moved = ", ".join(f"{x} + {num(h / 6.0)} * (k1_{d} + {num(2)} * k2_{d} + {num(2)} * k3_{d} + k4_{d}) AS {x}" for d, x in enumerate(xs))
    return f"WITH RECURSIVE flow AS (SELECT {cols}, 0 AS done FROM {points} UNION ALL SELECT {', '.join(keep)}, {moved}, {t} + {num(h)} AS {t}, done + 1 AS done FROM ({stage}) AS s) SELECT {', '.join([*keep, *xs])} FROM flow WHERE done = {steps}"


def double_gyre(x: list[str], t: str) -> list[str]:
    pi, amp = float(np.pi), 0.25
    s = f"({num(0.25)} * sin({num(2.0 * pi)} * {t}))"
    rest = f"({num(1)} - {num(2)} * {s})"
    fx, dfdx = f"({s} * {x[0]} * {x[0]} + {rest} * {x[0]})", f"({num(2)} * {s} * {x[0]} + {rest})"
    return [f"({num(-pi * amp)} * sin({num(pi)} * {fx}) * cos({num(pi)} * {x[1]}))", f"({num(pi * amp)} * cos({num(pi)} * {fx}) * sin({num(pi)} * {x[1]}) * {dfdx})"]
