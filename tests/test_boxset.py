import numpy as np
import pytest

from setflow import Box, BoxPartition, BoxSet

P44 = BoxPartition(Box([0, 0], [1, 1]), [4, 4])
P = BoxPartition(Box([0, 0, 0], [1, 1, 1]), [16, 8, 8])
PTS = {1: (0.5, 0.5, 0.5), 2: (-0.5, 0.5, 0.5), 3: (0.5, -0.5, 0.5), 4: (0.51, 0.51, 0.51)}


def cover(spark, *which):
    return BoxSet.cover(P, spark.createDataFrame([PTS[i] for i in which], "x double, y double, z double"), ["x", "y", "z"])


def test_algebra(spark):
    half, over = BoxSet.from_keys(spark, P44, range(8)), BoxSet.from_keys(spark, P44, range(4, 12))
    assert (half | over).keys() == list(range(12)) and (half & over).keys() == [4, 5, 6, 7]
    assert (half - over).keys() == [0, 1, 2, 3] and (half ^ over).keys() == [0, 1, 2, 3, 8, 9, 10, 11]
    full = BoxSet.full(spark, P44)
    assert half <= full and full >= half and not full <= half and half == BoxSet.from_keys(spark, P44, list(range(8)) * 2)
    assert hash(half) == hash(BoxSet.from_keys(spark, P44, range(8))) and 3 in half and 9 not in half
    with pytest.raises(ValueError):
        half | BoxSet.full(spark, P)


def test_sources(spark):
    assert BoxSet.full(spark, P).count() == 1024 and BoxSet.full(spark, P).subdivide(0).count() == 2048
    assert BoxSet.empty(spark, P).is_empty() and BoxSet.empty(spark, P).bounds_arrays()[0].tolist() == [np.inf] * 3
    for keys in ([-1], [16]):
        with pytest.raises(ValueError):
            BoxSet.from_keys(spark, P44, keys)
    frame = spark.createDataFrame([(3,), (3,), (None,), (5,)], "key long")
    assert BoxSet.from_frame(P44, frame).keys() == [3, 5]
    with pytest.raises(Exception, match="outside the grid"):
        BoxSet.from_frame(P44, spark.createDataFrame([(99,)], "key long")).keys()


def test_cover_and_subdivision(spark):
    c = cover(spark, 1, 2, 3, 4)
    assert c.count() == 3
    for k in range(10):
        c = c.subdivide(k % 3)
    assert c.count() == 3 * 2**10
    keys = set(c.keys())
    assert all(c.partition.point_to_key(p) in keys for p in PTS.values())
    one = cover(spark, 1)
    assert BoxSet.from_box(spark, P, P.key_to_box(one.keys()[0])) == one
    assert [len(a) for a in (one | cover(spark, 3), one | cover(spark, 1, 2), cover(spark, 1, 2) | cover(spark, 2, 3))] == [2, 2, 3]
    assert [len(a) for a in (one & cover(spark, 3), one & cover(spark, 1, 2), cover(spark, 2, 3) & cover(spark, 2, 3))] == [0, 1, 2]
    assert [len(a) for a in (one - cover(spark, 3), one - cover(spark, 1, 2), cover(spark, 1, 2) - one)] == [1, 0, 1]


def test_cover_ignores_outside_nan_and_null(spark):
    rows = [(0.1, 0.1), (5.0, 0.0), (float("nan"), 0.0), (None, 0.0), (1.0, 0.0)]
    assert BoxSet.cover(P44, spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).keys() == [10]


def test_geometry(spark):
    s = BoxSet.from_keys(spark, P44, [0, 5])
    assert [tuple(r) for r in s.centers().orderBy("key").collect()] == [(0, -0.75, -0.75), (5, -0.25, -0.25)]
    assert [tuple(r) for r in s.multi_indices().orderBy("key").collect()] == [(0, 0, 0), (5, 1, 1)]
    lo, hi = s.bounds_arrays()
    assert lo.tolist() == [-1, -1] and hi.tolist() == [0, 0]
    assert s.boxes().first()["radius"] == [0.25, 0.25]
    assert s.subdivide_all().partition.dims == (8, 8) and s.subdivide_all().count() == 8


@pytest.mark.parametrize("domain", [Box([0, 0], [1, 1]), Box([0.3, -0.2], [1.5, 0.7])])
@pytest.mark.parametrize("dims", [[8, 8], [3, 5], [2, 16], [7, 4]])
def test_repartition_agrees_with_brute_force(spark, domain, dims):
    s, new = BoxSet.from_keys(spark, P44, [1, 2, 7, 10, 15]), BoxPartition(domain, dims)
    r, rn = P44.cell_radius, new.cell_radius
    eps = np.minimum(r, rn) * 1e-10
    old, centers = P44.centers_batch(np.array(s.keys())), new.centers_batch(np.arange(new.size))
    near = ((centers[:, None] >= old[None] - r - eps) & (centers[:, None] < old[None] + r + eps)).all(-1).any(-1)
    assert s.repartition(new).keys() == np.nonzero(near)[0].tolist()
    assert BoxSet.empty(spark, P44).repartition(new).is_empty()
