import math

import numpy as np
import pytest

from setflow import BatchMap, Box, BoxPartition, BoxSet, ColumnMap, FlowMap, GridMap, MonteCarloMap, NonautonomousMap, PointMap, TimeSpanFlow, box_map, grid_points, lattice, rk4_step
from setflow.functions import systems as S

D = Box([0, 0], [1, 1])
P = BoxPartition(D, [32, 32])
CORNERS = np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, -1.0], [1.0, 1.0]])
EDGES = np.concatenate([CORNERS, [[-1, 0], [1, 0], [0, -1], [0, 1]]])


def square_point(p):
    return np.array([p[0] ** 2, p[1] ** 2])


def square_batch(p):
    return p * p


def test_square_image(spark):
    src = BoxSet.cover(P, spark.createDataFrame([(0.0, 0.0), (0.5, 0.0), (0.0, -0.5)], "x double, y double"), ["x", "y"])
    assert src.keys() == [520, 528, 784]
    for f in (ColumnMap(S.square, D, EDGES), BatchMap(square_batch, D, EDGES), PointMap(square_point, D, EDGES)):
        assert f(src).keys() == [528, 531, 532, 656, 688]


def test_engines_agree(spark):
    cells = BoxSet.from_keys(spark, P, range(0, 1024, 7))
    u = np.random.default_rng(3).uniform(-1, 1, (9, 2))
    maps = [ColumnMap(S.square, D, u), BatchMap(square_batch, D, u), PointMap(square_point, D, u)]
    counts = [sorted(map(tuple, m.counted(cells).collect())) for m in maps]
    assert counts[0] == counts[1] == counts[2]
    assert sorted(map(tuple, maps[0].hits(cells).collect())) == sorted(map(tuple, maps[1].hits(cells).collect()))


def test_engine_choice():
    u = grid_points(2, 2)
    assert isinstance(box_map(S.henon, D, u), ColumnMap) and isinstance(box_map(square_batch, D, u), BatchMap) and isinstance(box_map(square_point, D, u), PointMap)
    with pytest.raises(ValueError):
        box_map(S.henon, D, u, "gpu")
    with pytest.raises(ValueError):
        ColumnMap(S.henon, D, [0.0, 0.0])
    assert GridMap(S.henon, D, [2, 3]).n_test_points == 6 and MonteCarloMap(S.henon, D, seed=1).n_test_points == 32
    assert np.array_equal(MonteCarloMap(S.henon, D, seed=1).unit_points, MonteCarloMap(S.henon, D, seed=1).unit_points)
    assert grid_points(1, 4).ravel().tolist() == [-1, -0.5, 0, 0.5]
    with pytest.raises(ValueError):
        grid_points(2, [4, 0])


def test_laws(spark):
    f = ColumnMap(S.henon, Box([0, 0], [3, 3]), lattice(2, -1, 1, 3))
    q = BoxPartition(f.domain, [24, 24])
    a, b = BoxSet.from_keys(spark, q, range(100, 200)), BoxSet.from_keys(spark, q, range(180, 300))
    assert f(a & b) <= f(a) and f(a | b) == f(a) | f(b) and f(BoxSet.empty(spark, q)).is_empty()
    few, many = GridMap(S.henon, f.domain, 2), GridMap(S.henon, f.domain, 4)
    assert few(a) <= many(a)
    assert ColumnMap(S.identity, f.domain, [[0.0, 0.0]])(a) == a


def test_nan_images_are_dropped(spark):
    def bad(p):
        return np.where(p[:, :1] < 0, np.nan, p)

    assert BatchMap(bad, D, [[0.0, 0.0]])(BoxSet.full(spark, P)).count() == 512


def test_rk4():
    decay, harmonic = (lambda x: -x), (lambda x: np.stack([x[:, 1], -x[:, 0]], axis=1))
    assert np.allclose(FlowMap(decay, 0.01, 100)(np.ones((3, 1))), math.exp(-1), rtol=1e-7)
    assert np.allclose(FlowMap(harmonic, 2 * math.pi / 400, 400)(np.array([[1.0, 0.0]])), [[1, 0]], atol=5e-4)
    assert np.allclose(rk4_step(decay, np.ones((1, 1)), 0.1), math.exp(-0.1), atol=1e-6)
    grow = TimeSpanFlow(lambda x, t: 2 * np.asarray(t)[..., None] * np.ones_like(x) if np.ndim(t) else 2 * t * np.ones_like(x), 0.0, 2.0, 0.01)
    assert np.allclose(grow(np.zeros((2, 1))), 4.0)
    with pytest.raises(ValueError):
        TimeSpanFlow(decay, 1.0, 1.0)
    assert np.allclose(S.lorenz(np.array([[1.0, 1, 1]])), [[0, 26, 0.6]]) and S.chua(np.zeros((2, 3))).shape == (2, 3)


def test_frames_agree_with_single_start_times(spark):
    g = BoxPartition(Box([1, 0.5], [1, 0.5]), [8, 4])
    f = NonautonomousMap(S.double_gyre, g.domain, lattice(2, -0.9, 0.9, 3), 0.0, 1.0, 0.1)
    cells, times = BoxSet.full(spark, g), [0.0, 0.3]
    rows = f.frames(cells, times).collect()
    for k, t in enumerate(times):
        assert sorted((r["src"], r["dst"], r["hits"]) for r in rows if r["frame"] == k) == sorted(map(tuple, f.with_t0(t).counted(cells).collect()))


def test_column_plan_is_one_stage_before_the_shuffle(spark):
    plan = ColumnMap(S.lozi, D, CORNERS)(BoxSet.full(spark, P)).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Cartesian" not in plan
