import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from setflow import (
    BatchMap, Box, BoxGraph, BoxMeasure, BoxPartition, BoxSet, ColumnMap, FlowMap, NonautonomousMap, TransferOperator, alpha_limit_set, finite_time_lyapunov_exponents, ftle_frames, grid_points,
    invariant_measure, lattice, maximal_invariant_set, morse_sets, morse_tiles, preimage, recurrent_set, relative_attractor, unstable_set,
)
from setflow.functions import systems as S
from setflow.operators import balance, graph, plotrel, spectral

D = Box([0, 0], [1, 1])
ONE = BoxPartition(D, [1, 1])
CORNERS = np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, -1.0], [1.0, 1.0]])
CENTER = np.zeros((1, 2))
HALF = ColumnMap(S.half_y, D, CORNERS)


@pytest.fixture(scope="module")
def lozi(spark):
    p = BoxPartition(Box([0, 0], [13.5, 6.75]), [2, 2])
    f = ColumnMap(S.lozi, p.domain, lattice(2, -1, 1, 3))
    a = relative_attractor(f, BoxSet.full(spark, p), 16)
    return f, a, TransferOperator(f, a, a)


def test_contraction(spark):
    assert relative_attractor(HALF, BoxSet.full(spark, ONE), 4).keys() == [1, 2, 3, 5, 6, 7, 9, 10, 11, 13, 14, 15]
    ten = relative_attractor(HALF, BoxSet.full(spark, ONE), 10)
    assert ten.partition.dims == (32, 32) and ten.keys() == [32 * i + j for i in range(32) for j in (15, 16, 17, 18)]


def test_empty_sets_keep_refining(spark):
    gone = ColumnMap(lambda x, y: [x + 9.0, y], D, CENTER)
    s = relative_attractor(gone, BoxSet.full(spark, ONE), 3)
    assert s.is_empty() and s.partition.dims == (4, 2)
    r = recurrent_set(gone, BoxSet.full(spark, ONE), 3)
    assert r.is_empty() and r.partition.dims == (2, 1)


def test_lozi(spark, lozi):
    _, a, t = lozi
    assert (a.partition.dims, a.count(), t.nnz(), t.raw_hits()) == ((512, 512), 1164, 3594, 8419)
    sums = t.edges.groupBy("src").sum("weight").collect()
    assert all(math.isclose(r[1], 1.0) for r in sums)
    hits = t.hits_per_cell()
    u = balance.shard_weights(balance.uniform_shards(a, 8).join(hits, "key"), 8)
    w = balance.shard_weights(balance.weighted_shards(a, hits, 8), 8)
    assert [r["weight"] for r in u.orderBy("shard").collect()] == [0, 593, 1294, 1314, 1304, 1305, 1304, 1305]
    assert [r["weight"] for r in w.orderBy("shard").collect()] == [1052, 1051, 1053, 1053, 1052, 1053, 1052, 1053]
    assert balance.imbalance(u).first()["imbalance"] == math.inf and balance.imbalance(w).first()["imbalance"] < 1.01


def test_four_wing(spark):
    p = BoxPartition(Box([0] * 3, [5] * 3), [2, 2, 2])
    f = BatchMap(FlowMap(S.four_wing, 0.01, 20), p.domain, grid_points(3, 4))
    a = relative_attractor(f, BoxSet.full(spark, p), 8)
    t = TransferOperator(f, a, a)
    assert (a.partition.dims, a.count(), t.nnz()) == ((16, 16, 8), 1442, 8244)


def test_driver_steps_change_nothing(spark, monkeypatch):
    p = BoxPartition(Box([0] * 3, [5] * 3), [2, 2, 2])
    f = BatchMap(FlowMap(S.four_wing, 0.01, 20), p.domain, grid_points(3, 2))
    near = relative_attractor(f, BoxSet.full(spark, p), 5)
    from setflow.operators import algorithms

    monkeypatch.setattr(algorithms, "LOCAL_CELLS", 0)
    assert relative_attractor(f, BoxSet.full(spark, p), 5).keys() == near.keys()


def test_unstable_set(spark):
    p = BoxPartition(D, [8, 8])
    seed = BoxSet.cover(p, spark.createDataFrame([(0.0, 0.0)], "x double, y double"), ["x", "y"])
    w = unstable_set(HALF, seed)
    assert w.keys() == [36, 44, 52, 60] and HALF(w) <= w and unstable_set(HALF, w) == w
    assert unstable_set(HALF, seed, max_iter=1).count() == 2


def test_preimages_and_invariant_sets(spark):
    p = BoxPartition(D, [4, 4])
    ident = ColumnMap(S.identity, D, CENTER)
    some = BoxSet.from_keys(spark, p, [1, 2, 3])
    assert preimage(ident, some, BoxSet.full(spark, p)) == some
    full = BoxSet.full(spark, ONE)
    assert alpha_limit_set(ident, full, 2).count() == 4 and maximal_invariant_set(ident, full, 2).partition.dims == (2, 2)
    assert maximal_invariant_set(ident, full, 2).count() == 4


def test_recurrence(spark, lozi):
    f, a, t = lozi
    g = BoxGraph(t)
    sizes = sorted((r["count"], r["component"]) for r in g.recurrent().groupBy("component").count().collect())
    assert sizes == [(1, 122095), (478, 118042)]
    tiles = g.tiles()
    assert sorted(set(tiles.to_dict().values())) == [1.0, 2.0] and tiles.support() == g.recurrent_set()
    p = BoxPartition(D, [4, 4])
    ident = ColumnMap(S.identity, D, CENTER)
    assert morse_sets(ident, BoxSet.full(spark, p)).count() == 16 and set(morse_tiles(ident, BoxSet.full(spark, p)).to_dict().values()) == set(map(float, range(1, 17)))
    zero = ColumnMap(S.scaled(0.0), D, CENTER)
    assert morse_sets(zero, BoxSet.full(spark, p)).keys() == [10]
    assert BoxGraph.from_boxmap(zero, BoxSet.full(spark, p)).strongly_connected_components().count() == 16
    with pytest.raises(ValueError):
        BoxGraph(TransferOperator(ident, BoxSet.full(spark, p), BoxSet.full(spark, p.subdivide(0))))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_on_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    src, dst = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    reach = np.eye(40, dtype=bool)
    reach[src, dst] = True
    for k in range(40):
        reach |= reach[:, [k]] & reach[[k], :]
    want = {int(v): int(min(np.nonzero(reach[v] & reach[:, v])[0])) for v in set(src) | set(dst)}
    keys, label = graph.scc_arrays(src, dst)
    assert dict(zip(keys.tolist(), label.tolist(), strict=True)) == want
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(src, dst, strict=True)], "src long, dst long")
    assert {r["key"]: r["component"] for r in graph.scc_distributed(edges).collect()} == want


def test_spectra(spark):
    p = BoxPartition(Box([0.5, 0.5], [0.5, 0.5]), [16, 16])
    t = TransferOperator(ColumnMap(S.baker, p.domain, grid_points(2, 2)), BoxSet.full(spark, p), BoxSet.full(spark, p))
    assert (t.nnz(), t.raw_hits()) == (512, 1024)
    values, vectors = t.eigs(1)
    assert abs(abs(values[0]) - 1) < 1e-9 and (t @ vectors[0]).equals(vectors[0])
    q = BoxPartition(Box([0.5], [0.5]), [256])
    g = TransferOperator(ColumnMap(S.logistic, q.domain, np.linspace(-0.99, 0.99, 400)[:, None]), BoxSet.full(spark, q), BoxSet.full(spark, q))
    assert (g.nnz(), g.raw_hits()) == (734, 102400)
    dense = np.abs(g.eigs(3)[0])
    assert np.allclose(dense, [1, 0.58395, 0.58395], atol=1e-4)
    keys = np.arange(256)
    m = spectral._Matrix(g, keys, keys, 10**6)
    assert np.allclose(np.abs(spectral._arnoldi(m, 3, "LM", 40)[0]), dense, atol=1e-6)
    block, _ = spectral.subspace_iteration(t, 2, rounds=6)
    assert abs(abs(block[0]) - 1) < 1e-6
    far = spectral.svds_distributed(t, 2, rounds=4)
    assert np.allclose(far[1], [1, 1], atol=1e-6) and (t @ far[2][0]).equals(far[0][0] * float(far[1][0]))
    with pytest.raises(ValueError):
        g.eigs(1, "XX")
    left, s, right = t.svds(2)
    assert np.allclose(s, [1, 1], atol=1e-8) and (t @ right[0]).equals(left[0] * s[0])


def test_svds_beyond_dense(spark, monkeypatch):
    p, q = BoxPartition(Box([0.5, 0.5], [0.5, 0.5]), [16, 16]), BoxPartition(Box([0.5], [0.5]), [256])
    for t in (
        TransferOperator(ColumnMap(S.logistic, q.domain, np.linspace(-0.99, 0.99, 400)[:, None]), BoxSet.full(spark, q), BoxSet.full(spark, q)),
        TransferOperator(ColumnMap(S.baker, p.domain, grid_points(2, 2)), BoxSet.full(spark, p), BoxSet.full(spark, p)),
        TransferOperator(ColumnMap(S.logistic, q.domain, np.linspace(-0.99, 0.99, 400)[:, None]), BoxSet.full(spark, q), BoxSet.from_keys(spark, q, range(200, 207))),
    ):
        monkeypatch.setattr(spectral, "DENSE_CELLS", 1500)
        want = t.svds(8)[1]
        monkeypatch.setattr(spectral, "DENSE_CELLS", 0)
        left, s, right = t.svds(8)
        assert s.shape == want.shape and np.allclose(s, want, atol=1e-8)
        a, b = (t @ right[1]).to_dict(), left[1].to_dict()
        assert all(abs(a.get(x, 0.0) - s[1] * b.get(x, 0.0)) < 1e-8 for x in {*a, *b})


def test_distributed_eigenvalues_settle_or_warn(spark):
    edges = spark.createDataFrame([(i, i, w) for i, w in enumerate([1.0, 0.98, 0.97, 0.5, 0.0, 0.0, 0.0, 0.0])], "src long, dst long, weight double")
    cells = edges.select(F.col("src").alias("key"))
    times = lambda b, names: spectral._product(edges, b, names, "src", "dst", cells)
    assert np.allclose(spectral._iterate(cells, times, 2, 60, 1e-8)[0], [1, 0.98], atol=1e-7)
    assert np.allclose(spectral._iterate(cells, times, 8, 60, 1e-8)[0], [1, 0.98, 0.97, 0.5], atol=1e-7)
    with pytest.warns(RuntimeWarning, match="did not converge"):
        spectral._iterate(cells, times, 2, 1, 1e-8)


def test_largest_eigenvalues():
    for d in (1 - np.arange(5000) / 1250, 0.6 ** np.arange(5000.0), np.repeat([1.0, 0.5], 1000), 1 - (np.arange(5000.0) / 5000) ** 1.5, np.ones(30)):
        d = np.abs(d)
        got, v = spectral._largest(len(d), lambda x, d=d: d * x, 3)
        assert np.allclose(got, np.sort(d)[::-1][:3], atol=1e-12) and np.allclose(v.T @ v, np.eye(3), atol=1e-10)
        assert np.linalg.norm(d[:, None] * v - v * got) < 1e-8
    with pytest.raises(ArithmeticError):
        spectral._largest(5000, lambda x: (1 - (np.arange(5000.0) / 5000) ** 1.5) * x, 3, cycles=1)


def test_invariant_density(spark):
    q = BoxPartition(Box([0.5], [0.5]), [256])
    g = TransferOperator(ColumnMap(S.logistic, q.domain, np.linspace(-0.99, 0.99, 400)[:, None]), BoxSet.full(spark, q), BoxSet.full(spark, q))
    mu = invariant_measure(g, 30).to_dict()
    x = q.centers_batch(np.arange(256)).ravel()
    want = 1 / (np.pi * np.sqrt(x * (1 - x)))
    got = np.array([mu[k] for k in range(256)]) * 256
    assert np.median(np.abs(got - want) / want) < 0.1


def test_ftle(spark):
    q = BoxPartition(Box([0.5], [0.5]), [8])
    m = finite_time_lyapunov_exponents(ColumnMap(S.doubling, q.domain, [[0.0]]), BoxSet.full(spark, q), 1.0)
    assert all(math.isclose(v, math.log(2), rel_tol=1e-6) for v in m.to_dict().values())
    p = BoxPartition(Box([0, 0], [3, 3]), [12, 12])
    a = finite_time_lyapunov_exponents(ColumnMap(S.henon, p.domain, CENTER), BoxSet.full(spark, p), 2.0).to_dict()
    b = finite_time_lyapunov_exponents(BatchMap(lambda x: np.stack([1 - 1.4 * x[:, 0] ** 2 + x[:, 1], 0.3 * x[:, 0]], axis=1), p.domain, CENTER), BoxSet.full(spark, p), 2.0).to_dict()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-6, abs_tol=1e-6) for k in a)
    g = BoxPartition(Box([1, 0.5], [1, 0.5]), [8, 4])
    f = NonautonomousMap(S.double_gyre, g.domain, CENTER, 0.0, 2.0, 0.1)
    rows = ftle_frames(f, BoxSet.full(spark, g), 2.0, [0.0, 0.25]).where("frame = 1").collect()
    single = finite_time_lyapunov_exponents(f.with_t0(0.25), BoxSet.full(spark, g), 2.0).to_dict()
    assert {r["key"]: r["weight"] for r in rows} == single


def test_balance_degenerate(spark):
    cells = BoxSet.full(spark, BoxPartition(D, [4, 4]))
    zero = spark.createDataFrame([], "key long, weight long")
    rows = balance.weighted_shards(cells, zero, 3).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in rows] == [6, 5, 5]
    assert balance.compute_imbalance([5]) == 1.0 and balance.compute_imbalance([0, 1]) == math.inf
    assert balance.should_rebalance([400, 150]) and not balance.should_rebalance([300, 150]) and not balance.should_rebalance([400, 200])


def test_plot_relations(spark):
    cells = BoxSet.from_keys(spark, BoxPartition(D, [4, 4]), [0, 5])
    assert tuple(plotrel.rectangles(cells).orderBy("key").first()) == (0, -1.0, -1.0, 0.5, 0.5)
    assert [tuple(c) for c in plotrel.quads(cells).orderBy("key").first()["corners"]] == [(-1, -1), (-0.5, -1), (-0.5, -0.5), (-1, -0.5)]
    with pytest.raises(ValueError):
        plotrel.hexahedra(cells)
    cube = BoxSet.from_keys(spark, BoxPartition(Box([0] * 3, [1] * 3), [2, 2, 2]), [0, 7])
    assert plotrel.hexahedra(cube).count() == 16 and [r["vertices"][0] for r in plotrel.hex_connectivity(cube).orderBy("cell").collect()] == [0, 8]


def test_published_four_wing_counts(spark):
    """The published case of 10 steps: 24,646 cells and 145,785 edges."""
    from setflow.plans import queries as q

    f, p = q.four_wing_map()
    a = relative_attractor(f, BoxSet.full(spark, p), 10)
    assert a.count() == 24_646
    assert TransferOperator(f, a, a).nnz() == 145_785


def test_splits_are_nearly_invariant(spark):
    """The double gyre's two sides have about half of the cells each and keep most of their mass."""
    from setflow.plans import queries as q

    side = {r["key"]: r["side"] for r in q.almost_invariant_split(spark, "").collect()}
    assert len(side) == 512 and 200 < sum(v > 0 for v in side.values()) < 312
    f = NonautonomousMap(S.double_gyre, q.GYRE.domain, lattice(2, -0.9, 0.9, 4), 0.0, 1.0, 0.05)
    cells = BoxSet.full(spark, q.GYRE)
    edges = TransferOperator(f, cells, cells).edges.collect()
    stays = sum(e["weight"] for e in edges if side[e["src"]] == side[e["dst"]])
    assert stays / len({e["src"] for e in edges}) > 0.9
    pairs = q.coherent_split(spark, "").collect()
    start, end = {r["key"]: r["start"] for r in pairs}, {r["key"]: r["end"] for r in pairs}
    assert sum(e["weight"] for e in edges if start[e["src"]] == end[e["dst"]]) / len(start) > 0.9


def test_first_vector_and_tolerance(spark, monkeypatch):
    p = BoxPartition(Box([0.5], [0.5]), [64])
    cells = BoxSet.full(spark, p)
    t = TransferOperator(ColumnMap(S.logistic, p.domain, grid_points(1, 8)), cells, cells)
    want = t.eigs(1)[0]
    monkeypatch.setattr(spectral, "DENSE_CELLS", 0)
    v0 = BoxMeasure.from_dict(spark, p, {3: 1.0, 40: 2.0})
    assert np.allclose(t.eigs(1, v0=v0)[0], want) and np.allclose(t.eigs(1, v0=v0, tol=1e-6)[0], want, atol=1e-4)
    assert np.allclose(spectral.subspace_iteration(t, 1, v0=v0, tol=1e-6)[0], want, atol=1e-3)
    with pytest.raises(ValueError):
        t.eigs(1, v0=BoxMeasure.from_dict(spark, p, {}))
    with pytest.raises(ValueError):
        t.eigs(1, v0=BoxMeasure.from_dict(spark, BoxPartition(Box([0.5], [0.5]), [32]), {0: 1.0}))


def test_unstable_set_in_tables_and_on_the_driver(spark, monkeypatch):
    from setflow.operators import algorithms

    p = BoxPartition(Box([0, 0], [13.5, 6.75]), [64, 64])
    f, seed = ColumnMap(S.lozi, p.domain, lattice(2, -1, 1, 3)), BoxSet.from_keys(spark, p, [64 * 32 + 32])
    few = algorithms.unstable_set(f, seed).keys()
    monkeypatch.setattr(algorithms, "LOCAL_CELLS", 0)
    monkeypatch.setattr(algorithms, "FRONTS", 2)
    assert algorithms.unstable_set(f, seed).keys() == few and algorithms.unstable_set(f, BoxSet.empty(spark, p)).count() == 0
    assert algorithms.relative_attractor(f, seed, 3).keys() == algorithms.relative_attractor(f, seed.stored(), 3).keys()
    assert algorithms.maximal_invariant_set(f, BoxSet.full(spark, p), 1).count() == algorithms.maximal_invariant_set(f, BoxSet.full(spark, p).stored(), 1).count()


def test_frames_have_their_own_operators(spark):
    from setflow.operators.transfer import FramedTransfer
    from setflow.plans import queries as q

    cells = BoxSet.full(spark, q.GYRE)
    f = NonautonomousMap(S.double_gyre, q.GYRE.domain, lattice(2, -0.9, 0.9, 2), 0.0, 1.0, 0.1)
    t = FramedTransfer(f, cells, [0.0, 0.25], cells)
    one = TransferOperator(f.with_t0(0.25), cells, cells)
    key = lambda e: sorted((r["src"], r["dst"], r["hits"], round(r["weight"], 12)) for r in e.collect())
    assert key(t.at(1).edges) == key(one.edges)
    assert np.allclose(t.at(1).eigs(2)[0], one.eigs(2)[0])


def test_auto_engine_raises_a_maps_own_errors():
    from setflow.operators.maps import box_map

    def broken(*x):
        raise ZeroDivisionError("in the map itself")

    with pytest.raises(ZeroDivisionError):
        box_map(broken, Box([0.0], [1.0]), np.zeros((1, 1)))
