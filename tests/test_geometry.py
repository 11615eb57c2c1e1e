import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setflow import Box, BoxPartition

EPS = 2.220446049250313e-16
UNIT3 = Box([0, 0, 0], [1, 1, 1])


def test_box_is_half_open():
    for p in [(0.5, 0.5, 0.5), (0, 0, 0), (-1, -1, -1), (0, 0, -1)]:
        assert p in UNIT3
    for p in [(1, 1, 1), (0, 1, 0), (0, 0, -2), (0, 2, 0)]:
        assert p not in UNIT3


def test_box_validation_and_immutability():
    for c, r in [([0], [0]), ([0], [-1]), ([0, 0], [1])]:
        with pytest.raises(ValueError):
            Box(c, r)
    with pytest.raises(AttributeError):
        UNIT3.center = (1,)


def test_box_algebra():
    a, b = Box([0, 0], [1, 1]), Box([1, 0], [1, 1])
    assert (a & b) == Box([0.5, 0], [0.5, 1]) and (a | b) == Box([0.5, 0], [1.5, 1])
    assert not a.intersects(Box([2, 0], [1, 1]))  # they touch
    with pytest.raises(ValueError):
        a & Box([2, 0], [1, 1])
    assert a <= a and Box([0, 0], [0.5, 0.5]) <= a and a >= Box([0.5, 0], [0.5, 1])
    assert a.isdisjoint(Box([5, 5], [1, 1])) and hash(a) == hash(Box([0, 0], [1, 1]))
    assert len(UNIT3.vertices) == 8 and UNIT3.volume == 8.0
    assert sum(x.volume for x in UNIT3.subdivide_all()) == 8.0 and len(UNIT3.subdivide(1)) == 2
    assert np.allclose(b.normalize(b.rescale(np.array([0.3, -0.2]))), [0.3, -0.2])


def test_point_table():
    p = BoxPartition(UNIT3, [4, 2, 2])
    e = np.array([EPS] * 3)
    inside = [(0.5, 0.5, 0.5), (-1, -1, -1), (0, 0, -1), np.array([0, 0, -1]) + e, np.array([0, 1, 0]) - e, np.array([0, 1, 0]) - 5 * e, np.array([0, 1, 0]) - 10 * e]
    for x in inside:
        assert 0 <= p.point_to_key(x) < 16
    for x in [(1, 1, 1), (0, 1, 0), (0, 0, -2), (0, 2, 0), (np.nan, 0, 0), (np.inf, 0, 0)]:
        assert p.point_to_key(x) is None
    with pytest.raises(ValueError):
        p.point_to_key((0, 0))
    q = BoxPartition(Box([0, 0], [1, 1]), [4, 4])
    assert q.key_to_box(0).center == (-0.75, -0.75) and q.key_to_box(5).center == (-0.25, -0.25) and q.point_to_key((0.1, -0.3)) == 9
    for k in (-1, 16, 116):
        with pytest.raises(IndexError):
            q.key_to_box(k)
    with pytest.raises(ValueError):
        q.multi_to_key((4, 0))


def test_partition_limits():
    with pytest.raises(ValueError):
        BoxPartition(Box([0, 0], [1, 1]), [2**32, 2**32])
    with pytest.raises(ValueError):
        BoxPartition(Box([0], [1]), [0])
    assert BoxPartition(Box([0, 0], [1, 1]), [1, 1]).subdivide_all().dims == (2, 2)
    assert BoxPartition(Box([0, 0], [1, 1]), [4, 2]).next_dim() == 1


@pytest.mark.parametrize("dims", [[7], [3, 5], [4, 2, 3], [2, 2, 2, 2]])
def test_round_trips(dims):
    n = len(dims)
    p = BoxPartition(Box([0.25] * n, [1.5] * n), dims)
    keys = np.arange(p.size)
    assert np.array_equal(p.point_to_key_batch(p.centers_batch(keys)), keys)
    assert [p.multi_to_key(p.key_to_multi(k)) for k in range(p.size)] == keys.tolist()


def test_columns_agree_with_numpy(spark):
    p = BoxPartition(Box([0.1, -0.3], [1.7, 0.9]), [13, 6])
    rng = np.random.default_rng(1)
    pts = rng.uniform(-2, 2, (2000, 2))
    pts[:6] = [[np.nan, 0], [np.inf, 0], [1e300, 0], p.domain.lo, p.domain.hi, np.nextafter(p.domain.hi, -9)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "i long, x double, y double")
    got = {r["i"]: r["k"] for r in df.select("i", p.key_or_null([F.col("x"), F.col("y")]).alias("k")).collect()}
    want = p.point_to_key_batch(pts)
    assert all((got[i] is None and want[i] == -1) or got[i] == want[i] for i in range(len(pts)))
    bounded = [r["k"] for r in df.orderBy("i").select(p.bounded_key_expr([F.col("x"), F.col("y")]).alias("k")).collect()]
    assert bounded == p.bounded_point_to_key_batch(pts).tolist()
    rows = p.all_keys(spark).select("key", F.array(*p.center_exprs(F.col("key"))).alias("c"), F.array(*p.multi_exprs(F.col("key"))).alias("m")).collect()
    assert all(tuple(r["m"]) == p.key_to_multi(r["key"]) and tuple(r["c"]) == tuple(p.centers_batch(np.array([r["key"]]))[0]) for r in rows)


@pytest.mark.parametrize("dims", [[3, 5], [4, 2, 3], [2, 2, 2, 2]])
def test_children_lie_in_their_parent(spark, dims):
    n = len(dims)
    p = BoxPartition(Box([0] * n, [1] * n), dims)
    for d in range(n):
        fine = p.subdivide(d)
        rows = p.all_keys(spark).select("key", F.explode(F.array(*p.child_exprs(F.col("key"), d))).alias("c")).collect()
        assert sorted(r["c"] for r in rows) == list(range(fine.size))
        assert all(p.point_to_key(fine.key_to_box(r["c"]).center) == r["key"] for r in rows)
    fine = p.subdivide_all()
    rows = p.all_keys(spark).select("key", F.explode(F.array(*p.all_child_exprs(F.col("key")))).alias("c")).collect()
    assert len(rows) == fine.size and all(p.point_to_key(fine.key_to_box(r["c"]).center) == r["key"] for r in rows)


def test_morton(spark):
    p = BoxPartition(Box([0, 0], [1, 1]), [2, 2])
    codes = {r["key"]: r["m"] for r in p.all_keys(spark).select("key", p.morton_expr(F.col("key")).alias("m")).collect()}
    assert codes == {0: 0, 2: 1, 1: 2, 3: 3}
    with pytest.raises(ValueError):
        BoxPartition(Box([0] * 4, [1] * 4), [2**16, 1, 1, 1]).morton_bits()


@settings(max_examples=60, deadline=None)
@given(st.floats(-3, 3), st.floats(0.01, 2), st.floats(-3, 3), st.floats(0.01, 2))
def test_keys_in_box_covers_what_intersects(c0, r0, c1, r1):
    p = BoxPartition(Box([0, 0], [1, 1]), [5, 7])
    query = Box([c0, c1], [r0, r1])
    ranges = p.ranges_in_box(query)
    found = set() if ranges is None else {p.multi_to_key((a, b)) for a in range(*ranges[0]) for b in range(*ranges[1])}
    assert {k for k in range(p.size) if p.key_to_box(k).intersects(Box([c0, c1], [r0 - 1e-9, r1 - 1e-9]))} <= found
