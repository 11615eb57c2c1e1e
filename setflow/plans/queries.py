"""Registry of queries over the driver's tables, with the SQL that an independent engine runs on the same tables.

Tables enter in three ways: numeric columns scaled to a grid's domain are points, covered cells are the seeds and domains
of map-driven algorithms, and consecutive events of a user are transitions. Scaling factors are powers of two, so both
engines evaluate identical operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import systems as S
from ..functions.geometry import Box, BoxPartition
from ..functions.ode import FlowMap
from ..operators import algorithms as A
from ..operators import balance, plotrel
from ..operators.boxset import BoxSet
from ..operators.graph import BoxGraph
from ..operators.maps import BatchMap, ColumnMap, NonautonomousMap, grid_points, lattice, monte_carlo_points
from ..operators.measure import BoxMeasure
from ..operators.transfer import FramedTransfer, TransferOperator
from ..sources.tables import table, transitions
from . import sqltext as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def grid(radius: list[float], dims: list[int], center: list[float] | None = None) -> BoxPartition:
    return BoxPartition(Box(center or [0.0] * len(radius), radius), dims)


# points

LINE = grid([32.0, 65536.0], [32, 64], [32.0, 65536.0])
PLANE = grid([1.0, 1.0], [64, 32])
LOZI = grid([13.5, 6.75], [32, 32])
LOZI0 = grid([13.5, 6.75], [2, 2])
HENON = grid([3.0, 3.0], [64, 64])
UNIT3 = lattice(2, -1.0, 1.0, 3)
CORNERS = np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, -1.0], [1.0, 1.0]])
CENTER = np.zeros((1, 2))


def orders(spark: SparkSession, sf: str, p: BoxPartition = PLANE) -> DataFrame:
    """One point per order, all over the domain."""
    r = p.domain.radius
    o = table(spark, sf, "orders")
    return o.select(((F.col("o_totalprice") / 262144.0 - 1.0) * F.lit(r[0])).alias("x"), ((F.col("o_orderkey") % 4096 / 2048.0 - 1.0) * F.lit(r[1])).alias("y"))


def orders_sql(p: BoxPartition = PLANE) -> str:
    r = p.domain.radius
    return f"(SELECT (o_totalprice / {Q.num(262144)} - {Q.num(1)}) * {Q.num(r[0])} AS x, ((o_orderkey % 4096) / {Q.num(2048)} - {Q.num(1)}) * {Q.num(r[1])} AS y FROM orders) AS po"


def customers(spark: SparkSession, sf: str, p: BoxPartition = PLANE) -> DataFrame:
    """One point per customer, in the right part of the domain."""
    r = p.domain.radius
    c = table(spark, sf, "customer")
    return c.select(((F.col("c_acctbal") / 8192.0 - 0.25) * F.lit(r[0])).alias("x"), ((F.col("c_custkey") % 512 / 256.0 - 1.0) * F.lit(r[1])).alias("y"))


def customers_sql(p: BoxPartition = PLANE) -> str:
    r = p.domain.radius
    return f"(SELECT (c_acctbal / {Q.num(8192)} - {Q.num(0.25)}) * {Q.num(r[0])} AS x, ((c_custkey % 512) / {Q.num(256)} - {Q.num(1)}) * {Q.num(r[1])} AS y FROM customer) AS pc"


def order_cells(spark: SparkSession, sf: str, p: BoxPartition = PLANE) -> BoxSet:
    return BoxSet.cover(p, orders(spark, sf, p), ["x", "y"])


def customer_cells(spark: SparkSession, sf: str, p: BoxPartition = PLANE) -> BoxSet:
    return BoxSet.cover(p, customers(spark, sf, p), ["x", "y"])


def OC(p: BoxPartition = PLANE) -> str:
    return Q.cover(p, orders_sql(p), ["x", "y"])


def CC(p: BoxPartition = PLANE) -> str:
    return Q.cover(p, customers_sql(p), ["x", "y"])


def order_measure(spark, sf) -> BoxMeasure:
    return BoxMeasure.histogram(PLANE, orders(spark, sf), ["x", "y"])


def customer_measure(spark, sf) -> BoxMeasure:
    return BoxMeasure.histogram(PLANE, customers(spark, sf), ["x", "y"])


def OM(p: BoxPartition = PLANE) -> str:
    return f"SELECT {Q.key_of(p, ['x', 'y'])} AS key, CAST(count(*) AS DOUBLE) AS weight FROM {orders_sql(p)} WHERE {Q.in_domain(p, ['x', 'y'])} GROUP BY 1"


def CM(p: BoxPartition = PLANE) -> str:
    return f"SELECT {Q.key_of(p, ['x', 'y'])} AS key, CAST(count(*) AS DOUBLE) AS weight FROM {customers_sql(p)} WHERE {Q.in_domain(p, ['x', 'y'])} GROUP BY 1"


# sources


@query(Q.cover(LINE, "lineitem", ["l_quantity", "l_extendedprice"]))
def cover_lineitem_2d(spark, sf):
    return BoxSet.cover(LINE, table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).df


EMB = grid([1.0, 1.0, 1.0], [16, 16, 16])


@query(f"SELECT DISTINCT {Q.key_of(EMB, ['a', 'b', 'c'])} AS key FROM (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings) AS e WHERE {Q.in_domain(EMB, ['a', 'b', 'c'])}")
def cover_embeddings_3d(spark, sf):
    e = F.col("embedding")
    return BoxSet.cover(EMB, table(spark, sf, "embeddings"), [e[k].cast("double") for k in range(3)]).df


@query(f"SELECT {Q.key_of(PLANE, ['least(greatest(x, -0.984375::DOUBLE), 0.984375::DOUBLE)', 'least(greatest(y, -0.96875::DOUBLE), 0.96875::DOUBLE)'])} AS key, count(*) AS n FROM (SELECT 2.0::DOUBLE * x AS x, y FROM {orders_sql()}) AS w GROUP BY 1")
def bounded_keys(spark, sf):
    key = PLANE.bounded_key_expr([F.lit(2.0) * F.col("x"), F.col("y")])
    return orders(spark, sf).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("SELECT range AS key FROM range(2048)")
def full_partition(spark, sf):
    return BoxSet.full(spark, PLANE).df


@query("SELECT x * 32 + y AS key FROM (SELECT range AS x FROM range(26, 48)) AS a, (SELECT range AS y FROM range(12, 21)) AS b")
def from_box_range(spark, sf):
    return BoxSet.from_box(spark, PLANE, Box([0.15625, 0.02], [0.34, 0.26])).df


@query(f"WITH c AS ({OC()}) SELECT key, key % 3 = 0 AS odd FROM c")
def boxset_from_frame(spark, sf):
    keys = order_cells(spark, sf).df
    return BoxSet.from_frame(PLANE, keys.unionByName(keys)).df.withColumn("odd", F.col("key") % 3 == 0)


# scalar functions


@query("SELECT a * 2 + b AS idx, -0.5::DOUBLE + a * 0.75::DOUBLE AS lo0, 0.25::DOUBLE + a * 0.75::DOUBLE AS hi0, -1::DOUBLE + b * 2::DOUBLE AS lo1, 1::DOUBLE + b * 2::DOUBLE AS hi1 FROM (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b)")
def box_subdivide(spark, sf):
    """The four quarters of a box."""
    rows = [(i, *(float(x) for d in range(2) for x in (b.lo[d], b.hi[d]))) for i, b in enumerate(Box([0.25, 1.0], [0.75, 2.0]).subdivide_all())]
    return spark.createDataFrame(rows, "idx int, lo0 double, hi0 double, lo1 double, hi1 double")


@query("SELECT * FROM (VALUES ('and', 0.5::DOUBLE, 1::DOUBLE, -1::DOUBLE, 1::DOUBLE, true), ('or', -1::DOUBLE, 2::DOUBLE, -1::DOUBLE, 3::DOUBLE, true), ('apart', NULL, NULL, NULL, NULL, false)) AS v(what, lo0, hi0, lo1, hi1, meet)")
def box_algebra(spark, sf):
    """What two boxes share, the box around both, and two that only touch."""
    a, b, c = Box([0.0, 0.0], [1.0, 1.0]), Box([1.25, 1.0], [0.75, 2.0]), Box([3.0, 0.0], [2.0, 1.0])
    rows = [(what, *(float(x) for d in range(2) for x in (box.lo[d], box.hi[d])), a.intersects(b)) for what, box in (("and", a & b), ("or", a | b))]
    return spark.createDataFrame([*rows, ("apart", None, None, None, None, not a.isdisjoint(c))], "what string, lo0 double, hi0 double, lo1 double, hi1 double, meet boolean")


@query(f"WITH c AS ({CC()}) SELECT key, {Q.centers_of(PLANE)[0]} AS c0, {Q.centers_of(PLANE)[1]} AS c1, {Q.num(PLANE.cell_radius[0])} AS r0, {Q.num(PLANE.cell_radius[1])} AS r1 FROM c")
def boxset_boxes(spark, sf):
    b = customer_cells(spark, sf).boxes()
    return b.select("key", *[F.col(c)[d].alias(f"{c[0]}{d}") for c in ("center", "radius") for d in range(2)])


@query(f"WITH c AS ({OC()}) SELECT key, {Q.multi_of(PLANE)[0]} AS m0, {Q.multi_of(PLANE)[1]} AS m1, {Q.centers_of(PLANE)[0]} AS x0, {Q.centers_of(PLANE)[1]} AS x1 FROM c")
def key_to_multi_centers(spark, sf):
    c = order_cells(spark, sf)
    return c.multi_indices().join(c.centers(), "key")


@query(f"WITH c AS ({OC()}) SELECT key, ({Q.multi_of(PLANE)[0]}) * 32 + ({Q.multi_of(PLANE)[1]}) AS again FROM c")
def multi_to_key(spark, sf):
    return order_cells(spark, sf).df.select("key", PLANE.multi_key_expr(PLANE.multi_exprs(F.col("key"))).alias("again"))


@query(f"WITH c AS ({OC()}) {Q.children(PLANE, 'c', 1)}")
def subdivide_dim(spark, sf):
    return order_cells(spark, sf).subdivide(1).df


@query(f"WITH c AS ({OC()}) SELECT ((key // 32) * 2 + a) * 64 + (key % 32) * 2 + b AS key FROM c, (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b)")
def subdivide_all(spark, sf):
    return order_cells(spark, sf).subdivide_all().df


@query(f"SELECT x, y, ((x - 0::DOUBLE) / 1::DOUBLE) AS u, 3::DOUBLE + y * 2::DOUBLE AS v, count(*) AS n FROM {orders_sql()} WHERE {Q.in_domain(PLANE, ['x', 'y'])} GROUP BY ALL")
def box_predicate_rescale(spark, sf):
    inside = orders(spark, sf).where(PLANE.domain.predicate([F.col("x"), F.col("y")]))
    u, v = Box([0.0], [1.0]).normalize_exprs([F.col("x")])[0], Box([3.0], [2.0]).rescale_exprs([F.col("y")])[0]
    return inside.groupBy("x", "y").agg(F.count("*").alias("n")).select("x", "y", u.alias("u"), v.alias("v"), "n")


# set algebra


@query(f"({OC()}) UNION ({CC()})")
def set_union(spark, sf):
    return (order_cells(spark, sf) | customer_cells(spark, sf)).df


@query(f"({OC()}) INTERSECT ({CC()})")
def set_intersection(spark, sf):
    return (order_cells(spark, sf) & customer_cells(spark, sf)).df


@query(f"({OC()}) EXCEPT ({CC()})")
def set_difference(spark, sf):
    return (order_cells(spark, sf) - customer_cells(spark, sf)).df


@query(f"WITH a AS ({OC()}), b AS ({CC()}) SELECT key FROM a FULL JOIN b USING (key) WHERE a.key IS NULL OR b.key IS NULL")
def set_symmetric_difference(spark, sf):
    return (order_cells(spark, sf) ^ customer_cells(spark, sf)).df


@query(f"WITH a AS ({OC()}), b AS ({CC()}) SELECT NOT EXISTS (FROM (SELECT key FROM b EXCEPT SELECT key FROM a)) AS sub, NOT EXISTS (FROM (SELECT key FROM a EXCEPT SELECT key FROM b)) AS super, (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AND NOT EXISTS (FROM (SELECT key FROM a EXCEPT SELECT key FROM b)) AS equal")
def subset_equality_flags(spark, sf):
    a, b = order_cells(spark, sf).stored(), customer_cells(spark, sf).stored()
    return spark.range(1).select(F.lit(b <= a).alias("sub"), F.lit(b >= a).alias("super"), F.lit(a.equals(b)).alias("equal"))


FINE, COARSE = grid([1.0, 1.0], [96, 80]), grid([1.0, 1.0], [24, 12])


def _repartition_sql(new: BoxPartition) -> str:
    eps = np.minimum(PLANE.cell_radius, new.cell_radius) * 1e-10
    near = " AND ".join(f"n.c{d} >= o.c{d} - {Q.num(r)} - {Q.num(e)} AND n.c{d} < o.c{d} + {Q.num(r)} + {Q.num(e)}" for d, (r, e) in enumerate(zip(PLANE.cell_radius, eps, strict=True)))
    o, n = Q.centers_of(PLANE), Q.centers_of(new)
    return f"WITH c AS ({CC()}), o AS (SELECT {o[0]} AS c0, {o[1]} AS c1 FROM c), n AS (SELECT key, {n[0]} AS c0, {n[1]} AS c1 FROM (SELECT range AS key FROM range({new.size}))) SELECT DISTINCT n.key FROM n JOIN o ON {near}"


@query(_repartition_sql(FINE))
def repartition_coarse_to_fine(spark, sf):
    return customer_cells(spark, sf).repartition(FINE).df


@query(_repartition_sql(COARSE))
def repartition_fine_to_coarse(spark, sf):
    return customer_cells(spark, sf).repartition(COARSE).df


@query(f"WITH c AS ({CC()}) SELECT min({Q.centers_of(PLANE)[0]} - {Q.num(PLANE.cell_radius[0])}) AS lo0, max({Q.centers_of(PLANE)[0]} + {Q.num(PLANE.cell_radius[0])}) AS hi0, min({Q.centers_of(PLANE)[1]} - {Q.num(PLANE.cell_radius[1])}) AS lo1, max({Q.centers_of(PLANE)[1]} + {Q.num(PLANE.cell_radius[1])}) AS hi1 FROM c")
def set_bounds(spark, sf):
    return customer_cells(spark, sf).bounds()


# measures


@query(OM())
def empirical_measure_orders(spark, sf):
    return order_measure(spark, sf).df


@query(f"WITH a AS ({OM()}), b AS ({CM()}) SELECT key, coalesce(a.weight, 0) + coalesce(b.weight, 0) AS weight FROM a FULL JOIN b USING (key)")
def measure_add(spark, sf):
    return (order_measure(spark, sf) + customer_measure(spark, sf)).df


@query(f"WITH a AS ({OM()}), b AS ({CM()}) SELECT key, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS weight FROM a FULL JOIN b USING (key) WHERE coalesce(a.weight, 0) != coalesce(b.weight, 0)")
def measure_subtract(spark, sf):
    return (order_measure(spark, sf) - customer_measure(spark, sf)).df


@query(f"WITH a AS ({OM()}) SELECT key, -(weight * {Q.num(3)}) / {Q.num(4)} AS weight FROM a")
def measure_scale(spark, sf):
    return (-(order_measure(spark, sf) * 3.0) / 4.0).df


_VOL = PLANE.cell_volume


@query(f"WITH a AS ({OM()}) SELECT round(sum(abs(weight)), 6) AS norm1, round(sqrt(sum((weight / {Q.num(_VOL**0.5)}) * (weight / {Q.num(_VOL**0.5)}))), 6) AS norm2, max(weight) AS norm_inf, sum(weight) AS total FROM a")
def measure_norms(spark, sf):
    m = order_measure(spark, sf).stored()
    found = {"norm1": m.norm(1.0) * _VOL, "norm2": m.norm(2.0), "norm_inf": m.norm(float("inf")), "total": m.total()}
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(k) for k, v in found.items()])


@query(f"WITH a AS ({OM()}) SELECT key, round(weight / (SELECT sqrt(sum((weight / {Q.num(_VOL**0.5)}) * (weight / {Q.num(_VOL**0.5)}))) FROM a), 9) AS weight FROM a")
def measure_normalize(spark, sf):
    return order_measure(spark, sf).normalize().df.select("key", F.round("weight", 9).alias("weight"))


@query(f"WITH a AS ({OM()}), r AS ({CC()}) SELECT sum(weight) AS mass FROM a WHERE key IN (SELECT key FROM r)")
def measure_region_mass(spark, sf):
    return spark.range(1).select(F.lit(order_measure(spark, sf)(customer_cells(spark, sf))).alias("mass"))


@query(f"WITH a AS ({OM()}) SELECT round(sum(({Q.centers_of(PLANE)[0]} * {Q.centers_of(PLANE)[0]} + {Q.centers_of(PLANE)[1]}) * weight), 6) AS integral FROM a")
def measure_integrate(spark, sf):
    m = order_measure(spark, sf).stored()
    return spark.range(1).select(F.round(F.lit(m.integrate(lambda x, y: x * x + y)), 6).alias("integral"))


@query(f"WITH a AS ({OM()}), b AS ({CM()}), d AS (SELECT key, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS weight FROM a FULL JOIN b USING (key)) SELECT key, weight > 0 AS positive FROM d WHERE weight != 0")
def measure_sign_split(spark, sf):
    d = (order_measure(spark, sf) - customer_measure(spark, sf)).stored()
    return d.positive().df.withColumn("positive", F.lit(True)).unionByName(d.negative().df.withColumn("positive", F.lit(False)))


@query(f"WITH a AS ({OM()}) SELECT x, y, coalesce(weight, 0) / {Q.num(_VOL)} AS density FROM (SELECT x, y, CASE WHEN {Q.in_domain(PLANE, ['x', 'y'])} THEN {Q.key_of(PLANE, ['x', 'y'])} END AS k FROM {customers_sql()}) AS p LEFT JOIN a ON a.key = p.k")
def density_lookup(spark, sf):
    return order_measure(spark, sf).density(customers(spark, sf), ["x", "y"])


@query(f"WITH a AS ({OM()}), t AS (SELECT key, weight FROM a ORDER BY weight DESC, key LIMIT 1) SELECT t.key, t.weight AS at_top, coalesce((SELECT weight FROM a WHERE key = 2047), 0) AS at_last FROM t")
def measure_getitem(spark, sf):
    """Weights looked up by key: of the heaviest cell, and of the grid's last cell."""
    m = order_measure(spark, sf).stored()
    top = m.df.orderBy(F.desc("weight"), "key").first()["key"]
    return spark.range(1).select(F.lit(top).cast("long").alias("key"), F.lit(m[top]).alias("at_top"), F.lit(m[2047]).alias("at_last"))


@query(f"WITH a AS ({OM()}) SELECT key, CASE WHEN key = (SELECT min(key) FROM a) THEN 0.5::DOUBLE ELSE weight END AS weight FROM a")
def measure_with_weight(spark, sf):
    m = order_measure(spark, sf).stored()
    return m.with_weight(m.df.agg(F.min("key")).first()[0], 0.5).df


@query(f"WITH a AS ({OM()}) SELECT key, weight / 2 AS weight FROM a")
def measure_from_weights(spark, sf):
    """Weights from a table, one for each cell of a set."""
    m = order_measure(spark, sf).stored()
    return BoxMeasure.from_weights(m.support(), m.df.select(F.col("key").cast("string").alias("cell"), (F.col("weight") / 2).alias("w")), "cell", "w").df


@query(f"WITH a AS ({OM()}), b AS ({CM()}) SELECT true AS same, NOT EXISTS (FROM (SELECT abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS d, abs(coalesce(b.weight, 0)) AS b FROM a FULL JOIN b USING (key)) WHERE d > 1e-8 + 1e-5 * b) AS other, true AS nearly, false AS doubled")
def measure_equality(spark, sf):
    """A measure against itself, another one, and itself times 1 + 1e-7 and 2."""
    a, b = order_measure(spark, sf).stored(), customer_measure(spark, sf).stored()
    found = {"same": a.equals(a), "other": a.equals(b), "nearly": a.equals(a * (1 + 1e-7)), "doubled": a.equals(a * 2.0)}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in found.items()])


@query(f"WITH a AS ({OM()}) SELECT key // 32 AS key, sum(weight) AS weight FROM a GROUP BY 1")
def measure_marginal(spark, sf):
    return order_measure(spark, sf).marginal(1).df


# images


def _image_sql(p, f, points, cells=None) -> str:
    return f"WITH c AS ({cells or OC(p)}) SELECT DISTINCT dst AS key FROM ({Q.hits(p, 'c', f, points)}) AS h"


LOZI_MAP, HENON_MAP = ColumnMap(S.lozi, LOZI.domain, UNIT3), ColumnMap(S.henon, HENON.domain, lattice(2, -0.9, 0.9, 4))


@query(_image_sql(LOZI, Q.lozi, UNIT3))
def image_lozi(spark, sf):
    return LOZI_MAP(order_cells(spark, sf, LOZI)).df


IKEDA = grid([2.0, 2.0], [64, 64], [0.5, 0.5])
IKEDA_MAP = ColumnMap(S.ikeda, IKEDA.domain, lattice(2, -0.93, 0.91, 4))


@query(_image_sql(IKEDA, Q.ikeda, lattice(2, -0.93, 0.91, 4), OC(IKEDA)))
def image_ikeda(spark, sf):
    return IKEDA_MAP(order_cells(spark, sf, IKEDA)).df


@query(_image_sql(HENON, Q.henon, lattice(2, -0.9, 0.9, 4)))
def image_henon(spark, sf):
    return HENON_MAP(order_cells(spark, sf, HENON)).df


@query(_image_sql(PLANE, Q.square, lattice(2, -1.0, 1.0, 3)))
def image_square(spark, sf):
    return ColumnMap(S.square, PLANE.domain, lattice(2, -1.0, 1.0, 3))(order_cells(spark, sf)).df


@query(_image_sql(PLANE, Q.shift_x, CENTER))
def image_shift(spark, sf):
    return ColumnMap(S.shift_x, PLANE.domain, CENTER)(order_cells(spark, sf)).df


@query(_image_sql(PLANE, Q.half_y, grid_points(2, 3)))
def image_grid_map(spark, sf):
    return ColumnMap(S.half_y, PLANE.domain, grid_points(2, 3))(order_cells(spark, sf)).df


MC = monte_carlo_points(2, 24, 7)


@query(_image_sql(PLANE, Q.square, MC))
def montecarlo_image(spark, sf):
    return ColumnMap(S.square, PLANE.domain, MC)(order_cells(spark, sf)).df


def _square_batch(x):
    return x * x


@query(_image_sql(PLANE, Q.square, MC))
def image_batch_engine(spark, sf):
    return BatchMap(_square_batch, PLANE.domain, MC)(order_cells(spark, sf)).df


@query(f"WITH q AS ({OC(LOZI)}), b AS ({CC(LOZI)}) SELECT DISTINCT src AS key FROM ({Q.hits(LOZI, 'q', Q.lozi, UNIT3)}) AS h WHERE dst IN (SELECT key FROM b)")
def preimage_lozi(spark, sf):
    return A.preimage(LOZI_MAP, customer_cells(spark, sf, LOZI), order_cells(spark, sf, LOZI)).df


# subdivision algorithms


def _steps_sql(parts) -> str:
    text, name, _ = parts
    return f"WITH {text}\nSELECT key FROM {name}"


ONE = grid([1.0, 1.0], [1, 1])
HENON0 = grid([3.0, 3.0], [4, 4])


@query(_steps_sql(Q.attractor(ONE, "SELECT 0::BIGINT AS key", 4, Q.half_y, CORNERS)))
def attractor_contraction_4(spark, sf):
    return A.relative_attractor(ColumnMap(S.half_y, ONE.domain, CORNERS), BoxSet.full(spark, ONE), 4).df


@query(_steps_sql(Q.attractor(LOZI0, OC(LOZI0), 8, Q.lozi, UNIT3)))
def attractor_lozi_8(spark, sf):
    return A.relative_attractor(LOZI_MAP, order_cells(spark, sf, LOZI0), 8).df


@query(_steps_sql(Q.attractor(LOZI0, OC(LOZI0), 16, Q.lozi, UNIT3)))
def attractor_lozi_16(spark, sf):
    return A.relative_attractor(LOZI_MAP, order_cells(spark, sf, LOZI0), 16).df


@query(_steps_sql(Q.attractor(HENON0, OC(HENON0), 8, Q.henon, lattice(2, -0.9, 0.9, 4))))
def attractor_henon_8(spark, sf):
    return A.relative_attractor(HENON_MAP, order_cells(spark, sf, HENON0), 8).df


def _alpha(p, c):
    return f"SELECT DISTINCT src AS key FROM ({Q.hits(p, c, Q.half_y, CORNERS)}) AS h WHERE dst IN (SELECT key FROM {c})"


@query(_steps_sql(Q.refined(ONE, "SELECT 0::BIGINT AS key", 6, _alpha)))
def alpha_limit_contraction(spark, sf):
    return A.alpha_limit_set(ColumnMap(S.half_y, ONE.domain, CORNERS), BoxSet.full(spark, ONE), 6).df


def _invariant(p, c):
    h = Q.hits(p, c, Q.lozi, UNIT3)
    return f"SELECT key FROM {c} WHERE key IN (SELECT dst FROM ({h}) AS h) AND key IN (SELECT src FROM ({h}) AS h WHERE dst IN (SELECT key FROM {c}))"


@query(_steps_sql(Q.refined(LOZI0, OC(LOZI0), 8, _invariant)))
def maximal_invariant_lozi(spark, sf):
    return A.maximal_invariant_set(LOZI_MAP, order_cells(spark, sf, LOZI0), 8).df


def _closure_sql(p, seed, f, points) -> str:
    step = Q.hits(p, "w", f, points)
    return f"WITH RECURSIVE w(key) AS (({seed}) UNION SELECT dst FROM ({step}) AS h) SELECT key FROM w"


EIGHT = grid([1.0, 1.0], [8, 8])


@query(_closure_sql(EIGHT, "SELECT 36::BIGINT AS key", Q.half_y, CORNERS))
def unstable_contraction(spark, sf):
    return A.unstable_set(ColumnMap(S.half_y, EIGHT.domain, CORNERS), BoxSet.from_keys(spark, EIGHT, [36])).df


@query(_closure_sql(LOZI, CC(LOZI), Q.lozi, UNIT3))
def unstable_lozi(spark, sf):
    return A.unstable_set(LOZI_MAP, customer_cells(spark, sf, LOZI)).df


# transfer operators

LOZI_ATTRACTOR = Q.attractor(LOZI0, OC(LOZI0), 8, Q.lozi, UNIT3)
LOGISTIC = grid([0.5], [256], [0.5])
LOGISTIC_POINTS = np.linspace(-0.99, 0.99, 400)[:, None]
BAKER = grid([0.5, 0.5], [16, 16], [0.5, 0.5])


def lozi_transfer(spark, sf, steps: int = 8) -> TransferOperator:
    cells = A.relative_attractor(LOZI_MAP, order_cells(spark, sf, LOZI0), steps)
    return TransferOperator(LOZI_MAP, cells, cells)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return lozi_transfer(spark, sf).edges


@query(f"WITH {LOZI_ATTRACTOR[0]}\n{Q.edges(LOZI_ATTRACTOR[2], LOZI_ATTRACTOR[1], Q.lozi, UNIT3, LOZI_ATTRACTOR[1])}")
def transfer_edges_lozi(spark, sf):
    return flagship(spark, sf)


@query(f"WITH c AS (SELECT range AS key FROM range(256)) {Q.edges(LOGISTIC, 'c', Q.logistic, LOGISTIC_POINTS, 'c')}")
def transfer_logistic_256(spark, sf):
    cells = BoxSet.full(spark, LOGISTIC)
    return TransferOperator(ColumnMap(S.logistic, LOGISTIC.domain, LOGISTIC_POINTS), cells, cells).edges


@query(f"WITH c AS (SELECT range AS key FROM range(256)) {Q.edges(BAKER, 'c', Q.baker, grid_points(2, 2), 'c')}")
def transfer_baker(spark, sf):
    cells = BoxSet.full(spark, BAKER)
    return TransferOperator(ColumnMap(S.baker, BAKER.domain, grid_points(2, 2)), cells, cells).edges


@query(f"WITH c AS ({OC(LOZI)}) {Q.edges(LOZI, 'c', Q.lozi, UNIT3, None)}")
def transfer_auto_codomain(spark, sf):
    return TransferOperator(LOZI_MAP, order_cells(spark, sf, LOZI)).edges


HALVES = grid([1.0, 1.0], [16, 8])


def _shift(spark) -> TransferOperator:
    left, right = BoxSet.from_box(spark, HALVES, Box([-0.5, 0.0], [0.5, 1.0])), BoxSet.from_box(spark, HALVES, Box([0.5, 0.0], [0.5, 1.0]))
    return TransferOperator(ColumnMap(S.shift_x, HALVES.domain, CENTER), left, right)


@query("SELECT range AS key, 0.03125::DOUBLE AS weight FROM range(64, 128)")
def push_forward_shift(spark, sf):
    t = _shift(spark)
    return t.push_forward(BoxMeasure.uniform(t.domain, 1 / 32)).df


@query("SELECT range AS key, 0.03125::DOUBLE AS weight FROM range(0, 64)")
def pull_back_shift(spark, sf):
    t = _shift(spark)
    return t.pull_back(BoxMeasure.uniform(t.codomain, 1 / 32)).df


def _push_sql(text: str, edges: str, start: str, rounds: int, digits: int = 9) -> str:
    out = f"WITH {text}, e AS MATERIALIZED ({edges}), m0 AS MATERIALIZED ({start})"
    for k in range(1, rounds + 1):
        out += f", m{k} AS MATERIALIZED (SELECT dst AS key, sum(e.weight * m.weight) AS weight FROM e JOIN m{k - 1} AS m ON e.src = m.key GROUP BY 1)"
    return out + f" SELECT key, round(weight, {digits}) AS weight FROM m{rounds} WHERE weight != 0"


@query(_push_sql(LOZI_ATTRACTOR[0], Q.edges(LOZI_ATTRACTOR[2], LOZI_ATTRACTOR[1], Q.lozi, UNIT3, LOZI_ATTRACTOR[1]), f"SELECT key, 1::DOUBLE AS weight FROM {LOZI_ATTRACTOR[1]}", 10))
def push_forward_lozi_10(spark, sf):
    t = lozi_transfer(spark, sf)
    mu = BoxMeasure.uniform(t.domain)
    for k in range(10):
        mu = t.push_forward(mu).stored() if k == 4 else t.push_forward(mu)
    return mu.df.select("key", F.round("weight", 9).alias("weight"))


@query(_push_sql("c AS (SELECT range AS key FROM range(256))", Q.edges(LOGISTIC, "c", Q.logistic, LOGISTIC_POINTS, "c"), "SELECT key, 1 / 256::DOUBLE AS weight FROM c", 50))
def invariant_measure_logistic_power50(spark, sf):
    cells = BoxSet.full(spark, LOGISTIC)
    t = TransferOperator(ColumnMap(S.logistic, LOGISTIC.domain, LOGISTIC_POINTS), cells, cells)
    return A.invariant_measure(t, 50).df.select("key", F.round("weight", 9).alias("weight"))


@query(f"WITH c AS ({OC(LOZI)}), e AS ({Q.edges(LOZI, 'c', Q.lozi, UNIT3, 'c')}) SELECT c.key, CAST(coalesce(sum(e.hits), 0) AS BIGINT) AS weight FROM c LEFT JOIN e ON e.src = c.key GROUP BY 1")
def hits_per_cell(spark, sf):
    c = order_cells(spark, sf, LOZI).stored()
    return TransferOperator(LOZI_MAP, c, c).hits_per_cell()


# graphs


def _scc_sql(p: BoxPartition, text: str, cells: str, f, points) -> str:
    return f"""WITH RECURSIVE {text}, h AS MATERIALIZED ({Q.hits(p, cells, f, points)}), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM h WHERE dst IN (SELECT key FROM {cells})),
reach(a, b) AS (SELECT src, dst FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON reach.b = e.src),
comp AS MATERIALIZED (SELECT c.key, least(c.key, coalesce(min(r.b), c.key)) AS component FROM {cells} AS c LEFT JOIN (SELECT r.a, r.b FROM reach AS r JOIN reach AS s ON r.a = s.b AND r.b = s.a) AS r ON r.a = c.key GROUP BY c.key),
rec AS MATERIALIZED (SELECT key, component FROM comp WHERE key IN (SELECT a FROM reach WHERE a = b))
"""


_SCC = _scc_sql(LOZI_ATTRACTOR[2], LOZI_ATTRACTOR[0], LOZI_ATTRACTOR[1], Q.lozi, UNIT3)


@query(_SCC + "SELECT key, component FROM comp")
def scc_components(spark, sf):
    return BoxGraph(lozi_transfer(spark, sf)).strongly_connected_components()


@query(_SCC + "SELECT key, component FROM comp")
def scc_distributed(spark, sf):
    return BoxGraph(lozi_transfer(spark, sf), local_edges=0).strongly_connected_components()


@query(_SCC + "SELECT key FROM rec")
def morse_sets(spark, sf):
    return BoxGraph(lozi_transfer(spark, sf)).recurrent_set().df


@query(_SCC + "SELECT key, CAST(dense_rank() OVER (ORDER BY component) AS DOUBLE) AS weight FROM rec")
def morse_tiles(spark, sf):
    return BoxGraph(lozi_transfer(spark, sf)).tiles().df


@query(_SCC.split(",\nreach(")[0] + f" {Q.edges(LOZI_ATTRACTOR[2], LOZI_ATTRACTOR[1], Q.lozi, UNIT3, LOZI_ATTRACTOR[1]).replace('SELECT src, dst, hits, hits / total AS weight', 'SELECT src, dst, hits / total AS weight', 1)}")
def graph_adjacency(spark, sf):
    return BoxGraph(lozi_transfer(spark, sf)).adjacency()


def _recurrent_sql(p: BoxPartition, steps: int) -> str:
    text, name = f"s0 AS MATERIALIZED ({OC(p)})", "s0"
    for k in range(1, steps + 1):
        dim = p.next_dim()
        text += f", c{k} AS MATERIALIZED ({Q.children(p, name, dim)})"
        p = p.subdivide(dim)
        text += f", e{k} AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({Q.hits(p, f'c{k}', Q.lozi, UNIT3)}) AS h WHERE dst IN (SELECT key FROM c{k}))"
        text += f", r{k}(a, b) AS (SELECT src, dst FROM e{k} UNION SELECT r{k}.a, e{k}.dst FROM r{k} JOIN e{k} ON r{k}.b = e{k}.src), s{k} AS MATERIALIZED (SELECT a AS key FROM r{k} WHERE a = b)"
        name = f"s{k}"
    return f"WITH RECURSIVE {text} SELECT key FROM {name}"


@query(_recurrent_sql(LOZI0, 6))
def recurrent_lozi_6(spark, sf):
    return A.recurrent_set(LOZI_MAP, order_cells(spark, sf, LOZI0), 6).df


# spectra: properties are tested, SQL has no eigensolver


@query("SELECT * FROM (VALUES (0, true, false), (1, false, true), (2, false, true)) AS v(idx, one, vanishes)")
def eigs_baker(spark, sf):
    """The baker's map has the eigenvalue 1; all others are 0, as a defective matrix shows them: under a tenth."""
    cells = BoxSet.full(spark, BAKER)
    values, _ = TransferOperator(ColumnMap(S.baker, BAKER.domain, grid_points(2, 2)), cells, cells).eigs(3)
    return spark.createDataFrame([(i, bool(abs(v - 1) < 1e-9), bool(abs(v) < 0.1)) for i, v in enumerate(values)], "idx int, one boolean, vanishes boolean")


@query("SELECT CAST(range AS INTEGER) AS idx, 1::DOUBLE AS sigma FROM range(3)")
def svds_shift(spark, sf):
    """A permutation's singular values are 1."""
    _, s, _ = _shift(spark).svds(3)
    return spark.createDataFrame([(i, round(float(v), 9)) for i, v in enumerate(s)], "idx int, sigma double")


GYRE = grid([1.0, 0.5], [32, 16], [1.0, 0.5])


@query()
def almost_invariant_split(spark, sf):
    """Two sides of the second eigenvector of the double gyre's operator."""
    cells = BoxSet.full(spark, GYRE)
    f = NonautonomousMap(S.double_gyre, GYRE.domain, lattice(2, -0.9, 0.9, 4), 0.0, 1.0, 0.05)
    _, vectors = TransferOperator(f, cells, cells).eigs(2)
    v = vectors[1]
    return v.positive().df.withColumn("side", F.lit(1)).unionByName(v.negative().df.withColumn("side", F.lit(-1)))


@query()
def coherent_split(spark, sf):
    """Two sides of the second singular vectors: a coherent pair at the start and the end of the flow."""
    cells = BoxSet.full(spark, GYRE)
    f = NonautonomousMap(S.double_gyre, GYRE.domain, lattice(2, -0.9, 0.9, 4), 0.0, 1.0, 0.05)
    left, _, right = TransferOperator(f, cells, cells).svds(2)
    return right[1].df.select("key", F.signum("weight").alias("start")).join(left[1].df.select("key", F.signum("weight").alias("end")), "key")


# Lyapunov exponents, flows


_D = float(min(HENON.cell_radius)) * 0.01


def _ftle_henon_sql() -> str:
    x0, x1 = Q.centers_of(HENON)
    at = {"f": Q.henon("x0", "x1"), "g0": Q.henon(f"(x0 + {Q.num(_D)})", "x1"), "g1": Q.henon("x0", f"(x1 + {Q.num(_D)})")}
    cols = ", ".join(f"{e} AS {n}_{d}" for n, v in at.items() for d, e in enumerate(v))
    jac = ", ".join(f"(g{i}_{d} - f_{d}) / {Q.num(_D)} AS {n}" for n, i, d in (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("d", 1, 1)))
    return f"WITH cells AS ({OC(HENON)}), x AS (SELECT key, {x0} AS x0, {x1} AS x1 FROM cells), v AS (SELECT key, {cols} FROM x), j AS (SELECT key, {jac} FROM v), s AS (SELECT key, a*a + b*b + c*c + d*d AS s, a*d - b*c AS det FROM j) SELECT key, round(ln(greatest(sqrt((s + sqrt(greatest(s*s - 4*det*det, 0))) / 2), 1e-15)) / 2, 6) AS weight FROM s"


@query(_ftle_henon_sql())
def ftle_henon_2d(spark, sf):
    m = A.finite_time_lyapunov_exponents(HENON_MAP, order_cells(spark, sf, HENON), 2.0)
    return m.df.select("key", F.round("weight", 6).alias("weight"))


DOUBLING = grid([0.5], [8], [0.5])


@query("SELECT range AS key, round(ln(2.0), 9) AS weight FROM range(8)")
def ftle_doubling(spark, sf):
    m = A.finite_time_lyapunov_exponents(ColumnMap(S.doubling, DOUBLING.domain, np.zeros((1, 1))), BoxSet.full(spark, DOUBLING), 1.0)
    return m.df.select("key", F.round("weight", 9).alias("weight"))


CUBE = grid([1.0] * 3, [4, 2, 3])


@query("SELECT range AS key, round(ln(3.0) / 2, 9) AS weight FROM range(24)")
def ftle_cube(spark, sf):
    """A linear map of three dimensions stretches by its largest factor everywhere."""
    f = ColumnMap(lambda x, y, z: [F.lit(3.0) * y, F.lit(-2.0) * x, F.lit(0.5) * z], CUBE.domain, np.zeros((1, 3)))
    return A.finite_time_lyapunov_exponents(f, BoxSet.full(spark, CUBE), 2.0).df.select("key", F.round("weight", 9).alias("weight"))


def _frames(p: BoxPartition, frames: int, units: np.ndarray) -> str:
    """Test points of all cells of a grid at the starts of all frames: ``frame, src, x0, x1, t``."""
    x = ", ".join(f"{c} + u{d} * {Q.num(r)} AS x{d}" for d, (c, r) in enumerate(zip(Q.centers_of(p), p.cell_radius, strict=True)))
    return f"(SELECT f.range AS frame, c.key AS src, {x}, f.range / {Q.num(frames)} AS t FROM (SELECT range AS key FROM range({p.size})) AS c, range({frames}) AS f, {Q.units(units)}) AS pts"


_E = float(min(GYRE.cell_radius)) * 0.01


def _ftle_frames_sql(frames: int, span: float, steps: int) -> str:
    c = Q.centers_of(GYRE)
    points = f"(SELECT f.range AS frame, key, i, {c[0]} + a * {Q.num(_E)} AS x0, {c[1]} + b * {Q.num(_E)} AS x1, f.range / {Q.num(frames)} AS t FROM (SELECT range AS key FROM range({GYRE.size})) AS c, range({frames}) AS f, (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1)) AS s(i, a, b)) AS pts"
    flow = Q.rk4(points, ["frame", "key", "i"], ["x0", "x1"], "t", Q.double_gyre, span, steps)
    d = lambda i, j: f"((g{i}.x{j} - g0.x{j}) / {Q.num(_E)})"
    jac = f"SELECT g0.frame, g0.key, {d(1, 0)} AS a, {d(2, 0)} AS b, {d(1, 1)} AS c, {d(2, 1)} AS d FROM y AS g0 JOIN y AS g1 USING (frame, key) JOIN y AS g2 USING (frame, key) WHERE g0.i = 0 AND g1.i = 1 AND g2.i = 2"
    return f"WITH y AS MATERIALIZED ({flow}), j AS ({jac}), s AS (SELECT *, a*a + b*b + c*c + d*d AS s, a*d - b*c AS det FROM j) SELECT CAST(frame AS INTEGER) AS frame, key, round(ln(greatest(sqrt((s + sqrt(greatest(s*s - 4*det*det, 0))) / 2), 1e-15)) / {Q.num(span)}, 6) AS weight FROM s"


@query(_ftle_frames_sql(6, 2.0, 20))
def ftle_double_gyre_frames(spark, sf):
    f = NonautonomousMap(S.double_gyre, GYRE.domain, np.zeros((1, 2)), 0.0, 2.0, 0.1)
    return A.ftle_frames(f, BoxSet.full(spark, GYRE), 2.0, np.arange(6) / 6).withColumn("weight", F.round("weight", 6))


_GYRE4 = lattice(2, -0.9, 0.9, 2)
_GYRE_HITS = f"SELECT CAST(frame AS INTEGER) AS frame, src, {Q.key_of(GYRE, ['x0', 'x1'])} AS dst, count(*) AS hits FROM ({Q.rk4(_frames(GYRE, 4, _GYRE4), ['frame', 'src'], ['x0', 'x1'], 't', Q.double_gyre, 1.0, 10)}) AS y WHERE {Q.in_domain(GYRE, ['x0', 'x1'])} GROUP BY ALL"


@query(_GYRE_HITS)
def double_gyre_frames(spark, sf):
    f = NonautonomousMap(S.double_gyre, GYRE.domain, _GYRE4, 0.0, 1.0, 0.1)
    return f.frames(BoxSet.full(spark, GYRE), np.arange(4) / 4)


@query(f"WITH e AS ({_GYRE_HITS}), w AS (SELECT *, hits / CAST(sum(hits) OVER (PARTITION BY frame, src) AS DOUBLE) AS weight FROM e) SELECT frame, dst AS key, round(sum(weight), 9) AS weight FROM w GROUP BY ALL")
def double_gyre_frames_push(spark, sf):
    """The uniform measure pushed forward in every frame."""
    f = NonautonomousMap(S.double_gyre, GYRE.domain, _GYRE4, 0.0, 1.0, 0.1)
    cells = BoxSet.full(spark, GYRE)
    t = FramedTransfer(f, cells, np.arange(4) / 4)
    uniform = cells.df.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("frame"), "key", F.lit(1.0).alias("weight"))
    return t.push_forward(uniform).withColumn("weight", F.round("weight", 9))


def four_wing_map(ndim_points: int = 4) -> tuple[BatchMap, BoxPartition]:
    p = grid([5.0] * 3, [4] * 3)
    return BatchMap(FlowMap(S.four_wing, 0.01, 20), p.domain, grid_points(3, ndim_points)), p


@query()
def attractor_four_wing(spark, sf):
    f, p = four_wing_map()
    return A.relative_attractor(f, BoxSet.full(spark, p), 10).df


# load balancing


def _morton_sql(p: BoxPartition) -> str:
    parts = [f"((({m}) >> {k}) & 1) << {k * p.ndim + d}" for d, (m, n) in enumerate(zip(Q.multi_of(p), p.dims, strict=True)) for k in range(max(1, (n - 1).bit_length()))]
    return " | ".join(f"({x})" for x in parts)


@query(f"WITH c AS ({OC()}) SELECT key, {_morton_sql(PLANE)} AS morton FROM c")
def morton_codes(spark, sf):
    return balance.morton_codes(order_cells(spark, sf))


@query(f"WITH c AS ({OC()}), z AS (SELECT key, {_morton_sql(PLANE)} AS morton FROM c) SELECT key, morton, CAST(ntile(8) OVER (ORDER BY morton) - 1 AS INTEGER) AS shard FROM z")
def morton_uniform_shards(spark, sf):
    return balance.uniform_shards(order_cells(spark, sf), 8)


_WEIGHTED = f"WITH a AS ({OM()}), z AS (SELECT key, CAST(weight AS BIGINT) AS weight, {_morton_sql(PLANE)} AS morton FROM a), w AS (SELECT *, sum(weight) OVER (ORDER BY morton) AS upto, sum(weight) OVER () AS total FROM z), g AS (SELECT key, morton, weight, CAST((SELECT count(*) FROM range(1, 8) AS s(k) WHERE k::DOUBLE * (total::DOUBLE / 8::DOUBLE) <= upto) AS INTEGER) AS shard FROM w)"


@query(_WEIGHTED + " SELECT * FROM g")
def morton_weighted_shards(spark, sf):
    m = order_measure(spark, sf).stored()
    return balance.weighted_shards(m.support(), m.df.select("key", F.col("weight").cast("long").alias("weight")), 8)


@query(_WEIGHTED + ", t AS (SELECT range AS shard, coalesce(sum(weight), 0)::DOUBLE AS w FROM range(8) LEFT JOIN g ON g.shard = range GROUP BY 1) SELECT round(max(w) / min(w), 9) AS imbalance, round((max(w) - avg(w)) / max(w), 9) AS idle FROM t")
def shard_imbalance(spark, sf):
    m = order_measure(spark, sf).stored()
    shards = balance.weighted_shards(m.support(), m.df.select("key", F.col("weight").cast("long").alias("weight")), 8)
    return balance.imbalance(balance.shard_weights(shards, 8)).select(F.round("imbalance", 9).alias("imbalance"), F.round("idle", 9).alias("idle"))


# plot relations


@query(f"WITH c AS ({CC()}) SELECT key, {Q.centers_of(PLANE)[0]} - {Q.num(PLANE.cell_radius[0])} AS x, {Q.centers_of(PLANE)[1]} - {Q.num(PLANE.cell_radius[1])} AS y, {Q.num(2 * PLANE.cell_radius[0])} AS w, {Q.num(2 * PLANE.cell_radius[1])} AS h FROM c")
def plot_relation_boxset(spark, sf):
    return plotrel.rectangles(customer_cells(spark, sf))


@query(f"WITH a AS ({OM()}) SELECT key, weight AS value, (weight - (SELECT min(weight) FROM a)) / (SELECT max(weight) - min(weight) FROM a) AS shade FROM a")
def plot_relation_measure(spark, sf):
    return plotrel.measure_rectangles(order_measure(spark, sf).stored()).select("key", "value", "shade")


@query(f"WITH c AS ({CC()}) SELECT key, i AS corner, {Q.centers_of(PLANE)[0]} + s * {Q.num(PLANE.cell_radius[0])} AS x, {Q.centers_of(PLANE)[1]} + t * {Q.num(PLANE.cell_radius[1])} AS y FROM c, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) AS k(i, s, t)")
def plot_quads(spark, sf):
    return plotrel.quads(customer_cells(spark, sf)).select("key", F.posexplode("corners").alias("corner", "p")).select("key", "corner", "p.x", "p.y")


def _corner(c: str, r: float, s: int) -> str:
    return f"{c} + {Q.num(s * r)}"


@query("WITH c AS (" + Q.cover(EMB, "(SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings) AS e", ["a", "b", "c"]) + ") " + " UNION ALL ".join(f"SELECT key, {i} AS corner, {', '.join(_corner(c, r, s) + f' AS {n}' for c, r, s, n in zip(Q.centers_of(EMB), EMB.cell_radius, signs, 'xyz', strict=True))} FROM c" for i, signs in enumerate(plotrel.HEX)))
def plot_hexahedra(spark, sf):
    e = F.col("embedding")
    return plotrel.hexahedra(BoxSet.cover(EMB, table(spark, sf, "embeddings"), [e[k].cast("double") for k in range(3)]))


_EMB_POINTS = "(SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings) AS e"


@query(f"WITH m AS (SELECT {Q.key_of(EMB, ['a', 'b', 'c'])} AS key, CAST(count(*) AS DOUBLE) AS w FROM {_EMB_POINTS} WHERE {Q.in_domain(EMB, ['a', 'b', 'c'])} GROUP BY 1), r AS (SELECT min(w) AS lo, max(w) AS hi FROM m) SELECT key, range AS corner, w AS value, CASE WHEN hi > lo THEN (w - lo) / (hi - lo) ELSE 0 END AS shade FROM m, r, range(8)")
def plot_hexahedra_measure(spark, sf):
    e = F.col("embedding")
    m = BoxMeasure.histogram(EMB, table(spark, sf, "embeddings"), [e[k].cast("double") for k in range(3)]).stored()
    return plotrel.measure_hexahedra(m).select("key", "corner", "value", "shade")


@query(f"WITH c AS ({Q.cover(EMB, _EMB_POINTS, ['a', 'b', 'c'])}), n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS cell FROM c) SELECT key, cell, range AS corner, cell * 8 + range AS vertex FROM n, range(8)")
def plot_hex_connectivity(spark, sf):
    e = F.col("embedding")
    cells = BoxSet.cover(EMB, table(spark, sf, "embeddings"), [e[k].cast("double") for k in range(3)])
    return plotrel.hex_connectivity(cells).select("key", "cell", F.posexplode("vertices").alias("corner", "vertex"))


@query(_SCC + ", t AS (SELECT key, dense_rank() OVER (ORDER BY component) AS label FROM rec) SELECT key, label, (label - 1) % 20 AS colour FROM t")
def plot_morse_tiles(spark, sf):
    return plotrel.tile_rectangles(BoxGraph(lozi_transfer(spark, sf)).tiles()).select("key", "label", "colour")


# transitions from data (an extension)

EVENT = grid([256.0], [32], [256.0])


@query(f"WITH s AS (SELECT user_id, ts, event_id, CASE WHEN {Q.in_domain(EVENT, ['value'])} THEN {Q.key_of(EVENT, ['value'])} END AS src FROM events), t AS (SELECT src, lead(src) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM s), n AS (SELECT src, dst, count(*) AS hits FROM t WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL) SELECT src, dst, hits, hits / CAST(sum(hits) OVER (PARTITION BY src) AS DOUBLE) AS weight FROM n")
def events_empirical_transfer(spark, sf):
    pairs = transitions(table(spark, sf, "events"), EVENT, ["value"], "user_id", ["ts", "event_id"])
    cells = BoxSet.full(spark, EVENT)
    return TransferOperator.from_edges(pairs, cells, cells).edges
