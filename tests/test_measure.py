import math

import pytest
from pyspark.sql import functions as F

from setflow import Box, BoxMeasure, BoxPartition, BoxSet, ColumnMap, TransferOperator
from setflow.functions import systems as S

P = BoxPartition(Box([0, 0], [1, 1]), [16, 8])


@pytest.fixture(scope="module")
def sides(spark):
    left, right = (BoxSet.from_box(spark, P, Box([c, 0], [0.5, 1])) for c in (-0.5, 0.5))
    return left, right, *(BoxMeasure.uniform(s, 1 / 32) for s in (left, right, BoxSet.full(spark, P)))


def test_laws(spark, sides):
    l_set, r_set, left, right, full = sides
    assert l_set.count() == r_set.count() == 64
    assert (left + right).equals(full) and (full - left).equals(right) and (left - full).equals(-right)
    assert (2 * left + 2 * right).equals(full + full) and (left / 2 + right / 2).equals(full / 2)
    assert full.total() == 4.0 and full.integrate(2.0) == 8.0 and full(l_set) == 2.0 and full(Box([-0.5, 0], [0.5, 1])) == 2.0
    assert (full - full).count() == 0 and BoxMeasure.zeros(l_set).count() == 64 and BoxMeasure.zeros(l_set).support().is_empty()
    with pytest.raises(ValueError):
        full + BoxMeasure.uniform(BoxSet.full(spark, P.subdivide(0)))


def test_norms(spark, sides):
    full = sides[4]
    vol = P.cell_volume
    for p in (1, 2, 3):
        assert math.isclose(full.norm(p), (128 * (1 / 32 / vol ** (1 / p)) ** p) ** (1 / p))
    assert full.norm(math.inf) == 1 / 32 and math.isclose(full.normalize().norm(), 1.0)
    with pytest.raises(ValueError):
        BoxMeasure.zeros(sides[0]).normalize()
    assert BoxMeasure.uniform(BoxSet.empty(spark, P)).integrate(1.0) == 0.0


def test_items(spark):
    m = BoxMeasure.from_dict(spark, P, {3: 1.0, 5: -2.0})
    assert m[3] == 1.0 and m[4] == 0.0 and m.with_weight(3, 7.0)[3] == 7.0
    with pytest.raises(KeyError):
        m.with_weight(4, 1.0)
    assert m.positive().keys() == [3] and m.negative().keys() == [5]
    dup = spark.createDataFrame([(3, 1.0), (3, 2.0)], "key long, weight double")
    assert BoxMeasure.from_frame(P, dup).to_dict() == {3: 3.0}
    assert BoxMeasure.from_boxset(BoxSet.from_keys(spark, P, [9, 4]), [1.0, 2.0]).to_dict() == {4: 1.0, 9: 2.0}


def test_density_and_marginal(spark, sides):
    left = sides[2]
    pts = spark.createDataFrame([(-0.5, 0.0), (0.5, 0.0), (9.0, 0.0), (None, 0.0)], "x double, y double")
    assert [r["density"] for r in left.density(pts, ["x", "y"]).orderBy(F.col("x").asc_nulls_last()).collect()] == [1 / 32 / P.cell_volume, 0, 0, 0]
    m = left.marginal(1)
    assert m.partition.dims == (16,) and m.to_dict() == {k: 0.25 for k in range(8)}


def test_shift_operator_is_exact(spark, sides):
    l_set, r_set, left, right, _ = sides
    t = TransferOperator(ColumnMap(S.shift_x, P.domain, [[0.0, 0.0]]), l_set, r_set)
    assert t.nnz() == 64 and all(r["dst"] == r["src"] + 64 for r in t.edges.collect())
    assert (t @ left).equals(right) and t.pull_back(right).equals(left) and t.shape() == (64, 64)
    with pytest.raises(ValueError):
        t.push_forward(BoxMeasure.uniform(BoxSet.full(spark, P.subdivide(0))))


def test_weights_from_a_table(spark):
    p = BoxPartition(Box([0, 0], [1, 1]), [4, 4])
    cells = BoxSet.from_keys(spark, p, [1, 5, 9])
    good = spark.createDataFrame([("1", 2), ("5", 3), ("9", 0)], "cell string, w int")
    assert BoxMeasure.from_weights(cells, good, "cell", "w").to_dict() == {1: 2.0, 5: 3.0, 9: 0.0}
    for bad in ([("1", 2), ("5", 3)], [("1", 2), ("5", 3), ("9", 1), ("2", 1)], [("1", 2), ("1", 2), ("5", 3), ("9", 1)], [("1", 2), ("5", 3), ("9", 1), (None, 1)]):
        with pytest.raises(Exception, match="key|cell"):
            BoxMeasure.from_weights(cells, spark.createDataFrame(bad, "cell string, w int"), "cell", "w").to_dict()
