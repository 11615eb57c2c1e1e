"""Relations that a plotting tool draws as they are: rectangles, colours, hexahedra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxset import BoxSet
from .measure import BoxMeasure
from .ordering import numbered

#: Corners of a hexahedron in the usual order of visualisation tools - fixed values.
HEX = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]


def _axes(ndim: int, axes: Sequence[int], n: int) -> None:
    if len(axes) != n or not all(0 <= a < ndim for a in axes):
        raise ValueError(f"{n} axes of 0..{ndim - 1} are needed")


def rectangles(cells: BoxSet, axes: Sequence[int] = (0, 1)) -> DataFrame:
    """``key, x, y, w, h``: lower left corner and size of each cell in two of its axes."""
    _axes(cells.partition.ndim, axes, 2)
    c, r = cells.partition.center_exprs(F.col("key")), cells.partition.cell_radius.tolist()
    a, b = axes
    return cells.df.select("key", (c[a] - F.lit(r[a])).alias("x"), (c[b] - F.lit(r[b])).alias("y"), F.lit(2.0 * r[a]).alias("w"), F.lit(2.0 * r[b]).alias("h"))


def quads(cells: BoxSet, axes: Sequence[int] = (0, 1)) -> DataFrame:
    """``key, corners``: four corners, counter-clockwise from the lower left."""
    _axes(cells.partition.ndim, axes, 2)
    c, r = cells.partition.center_exprs(F.col("key")), cells.partition.cell_radius.tolist()
    a, b = axes
    corner = [F.struct((c[a] + F.lit(s * r[a])).alias("x"), (c[b] + F.lit(t * r[b])).alias("y")) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return cells.df.select("key", F.array(*corner).alias("corners"))


def _shade(weight: Column, absolute: bool, rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("value", F.abs(weight) if absolute else weight)
    ends = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    shade = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(ends)).withColumn("shade", shade).drop("lo", "hi")  # ends is one row


def measure_rectangles(mu: BoxMeasure, axes: Sequence[int] = (0, 1), absolute: bool = False) -> DataFrame:
    """``key, x, y, w, h, value, shade``: shade is the value scaled to 0..1 over the measure."""
    shaded = _shade(F.col("weight"), absolute, mu.df)
    return rectangles(BoxSet(mu.partition, mu.df), axes).join(shaded.select("key", "value", "shade"), "key")


def _labels(tiles: BoxMeasure, colours: int) -> DataFrame:
    label = F.col("weight").cast("long")
    return tiles.df.select("key", label.alias("label"), F.pmod(label - 1, F.lit(colours).cast("long")).alias("colour"))


def tile_rectangles(tiles: BoxMeasure, axes: Sequence[int] = (0, 1), colours: int = 20) -> DataFrame:
    """``key, x, y, w, h, label, colour``: labels 1, 2, ... and colours in turn."""
    return rectangles(BoxSet(tiles.partition, tiles.df), axes).join(_labels(tiles, colours), "key")


def hexahedra(cells: BoxSet, axes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """``key, corner, x, y, z``: eight corners per cell."""
    _axes(cells.partition.ndim, axes, 3)
    c, r = cells.partition.center_exprs(F.col("key")), cells.partition.cell_radius.tolist()
    corners = F.array(*[F.struct(*[(c[a] + F.lit(float(s) * r[a])).alias(n) for a, s, n in zip(axes, signs, "xyz", strict=True)]) for signs in HEX])
    return cells.df.select("key", F.posexplode(corners).alias("corner", "p")).select("key", "corner", "p.x", "p.y", "p.z")


def measure_hexahedra(mu: BoxMeasure, axes: Sequence[int] = (0, 1, 2), absolute: bool = False) -> DataFrame:
    """``key, corner, x, y, z, value, shade``: shade is the value scaled to 0..1 over the measure."""
    shaded = _shade(F.col("weight"), absolute, mu.df)
    return hexahedra(BoxSet(mu.partition, mu.df), axes).join(shaded.select("key", "value", "shade"), "key")


def tile_hexahedra(tiles: BoxMeasure, axes: Sequence[int] = (0, 1, 2), colours: int = 20) -> DataFrame:
    """``key, corner, x, y, z, label, colour``: labels 1, 2, ... and colours in turn."""
    return hexahedra(BoxSet(tiles.partition, tiles.df), axes).join(_labels(tiles, colours), "key")


def hex_connectivity(cells: BoxSet) -> DataFrame:
    """``key, cell, vertices``: cells numbered in key order, each with the numbers of its eight corners."""
    rows = numbered(cells.df, "key", "cell")
    return rows.select("key", "cell", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("cell") * 8 + i).alias("vertices"))


