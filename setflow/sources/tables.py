"""Adapters from ordinary tables to the engine's inputs: points, weighted points, trajectories, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import BoxPartition


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any format that Spark reads; columns are pruned and range filters pushed into the scan by what follows."""
    return spark.read.format(fmt).options(**options).load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """``x0, x1, ...`` as doubles."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"x{d}") for d, c in enumerate(cols)])


def transitions(df: DataFrame, partition: BoxPartition, cols: Sequence[str], who: str, when: Sequence[str]) -> DataFrame:
    """``(src, dst, hits)`` from consecutive points of trajectories in a table.

    An extension: it estimates a transfer operator from data instead of a known map. A trajectory is a group
    ``who`` ordered by ``when``; steps that start or end outside the grid are left out.
    """
    key = partition.key_or_null([F.col(c) for c in cols])
    step = df.select(who, *when, key.alias("src")).withColumn("dst", F.lead("src").over(Window.partitionBy(who).orderBy(*when)))
    return step.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("hits"))


def write_cells(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Sink for any relation of the engine."""
    df.write.format(fmt).mode(mode).save(path)
