"""Shared helpers: word splitting, durable intermediate tables, clean column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import discard, scratch, shared_dir, stored

__all__ = ["alnum_words", "ascii_lower", "discard", "fresh", "hold_small_batches", "read", "scratch", "shared_dir", "small_batches", "space_words", "stored"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between alphanumeric words once A-Z are lower-cased.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words that are runs of anything but ASCII white space.
SPACE_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def hold_small_batches(spark: SparkSession, most: int = 4 << 20) -> str:
    """Hold Arrow batches to Python to ``most`` bytes: long texts would else make batches of tens of megabytes per task.

    The session's setting before; Spark reads it when a plan runs, so operators whose result is lazy must leave it set.
    """
    before = str(spark.conf.get(BATCH_KEY))
    if int(before.rstrip("b")) > most:
        spark.conf.set(BATCH_KEY, f"{most}b")
    return before


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """``hold_small_batches`` while the block runs, for what is written inside it."""
    before = hold_small_batches(spark, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() may only be used on pure ASCII; translate() is slower."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Array of alphanumeric words of a text; null gives no words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), "")


def space_words(text: Column) -> Column:
    """Array of the white-space separated words of a text, as they are; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_GAP), "")
