"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the id. A bucket that exceeds the byte limit is
split on its next bit; others stay, so a shard is named by as many bits as it needed. Byte counts are summed
per directory entry (a few entries per shard) before any shuffle; each entry adds to its ancestors; an entry's
depth is the number of ancestors over the limit. Entries still over the limit at the directory's width are
opened again on further bits.

The 52 bits of the id's hash are followed by 52 bits of a hash of the row's place in a stored table, so that rows
that share an id (repeated rows, null ids) also split. A document that alone exceeds the limit is split off
until it is alone in its shard, which is then reported over the limit.

Defined results: null and empty texts have 0 bytes and still belong to a shard; ids may be of any type and null, and equal ids
share the first word of bits; a very long text counts with all its bytes and, if over the limit, ends alone in its shard; a limit
met exactly does not split; an empty table has no shards. Input columns named like those added
(``__h0, __h1, __bytes, __depth, __shard``, and ``__place`` while rows of one id are split) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

BITS = 52


def hash_bits(key: Column, seed: str = "") -> Column:
    """52 bits of a hash as a bigint."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _entry(word: int, width: int) -> tuple[Column, Column]:
    """The two words of a row's directory entry; the second is 0 while bits of the first are in use."""
    if word == 0:
        return F.shiftrightunsigned(F.col("__h0"), BITS - width), F.lit(0).cast("long")
    return F.col("__h0"), F.shiftrightunsigned(F.col("__h1"), BITS - width)


def directory(rows: DataFrame, limit: int, step: int | None = None, words: int = 2) -> tuple[DataFrame, bool]:
    """``(word, width, p0, p1, depth)``: for every leaf entry the number of bits that name its shard; and whether the bits ran out.

    ``rows(__h0, __h1, __bytes)``. Entries of word 1 lie below all bits of word 0.
    """
    total = rows.agg(F.sum("__bytes").alias("b")).first()["b"] or 0
    step = step or min(20, max(4, math.ceil(math.log2(total / limit + 1)) + 3))
    parts, open_rows, done = [], rows, 0
    while True:
        word, low = divmod(done, BITS)
        width = min(low + step, BITS)
        last, end = BITS * word + width, BITS * words
        p0, p1 = _entry(word, width)
        leaves = stored(open_rows.groupBy(p0.alias("p0"), p1.alias("p1")).agg(F.sum("__bytes").alias("bytes"), F.count("*").alias("n")), "directory")
        own, other = ("p1", "p0") if word else ("p0", "p1")
        sums = leaves
        up = leaves.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(width)))).withColumn("a", F.expr(f"shiftrightunsigned({own}, {width} - d)"))
        big = up.groupBy("d", "a", other).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where(f"bytes > {limit} and n > 1").select("d", "a", other)
        deep = up.join(big, ["d", "a", other]).groupBy("p0", "p1").agg(F.max("d").alias("d"))
        depth = F.coalesce(F.col("d") + 1, F.lit(low)) + BITS * word
        leaves = stored(leaves.join(deep, ["p0", "p1"], "left").select(F.lit(word).alias("word"), F.lit(width).alias("width"), "p0", "p1", depth.cast("int").alias("depth")), "leaves")
        discard(sums)
        over = leaves.where(f"depth > {last}")
        stuck = not over.isEmpty()
        parts.append(leaves.where(f"depth <= {last}") if stuck and last < end else leaves.withColumn("depth", F.least("depth", F.lit(last))))
        if not stuck or last == end:
            break
        over = over.select("p0", "p1")
        was = open_rows
        open_rows, done = stored(open_rows.join(over, (p0 == F.col("p0")) & (p1 == F.col("p1")), "left_semi"), "oversized"), last
        if was is not rows:
            discard(was)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out, stuck


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int | None = None, place_col: str | None = None) -> DataFrame:
    """``docs`` with ``__bytes``, ``__depth`` and ``__shard`` (its leading bits as a string; empty if one shard is enough)."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    second = hash_bits(F.col(place_col), "row:") if place_col else F.lit(0).cast("long")
    rows = docs.withColumns({"__h0": hash_bits(F.col(id_col)), "__h1": second, "__bytes": size})
    hashes = stored(rows.select("__h0", "__h1", "__bytes"), "hashes")
    table, stuck = directory(hashes, limit, step, words=2 if place_col else 1)
    discard(hashes)
    if stuck and not place_col:  # rows of one id exceed the limit: number them, durably, and split on the number too
        placed = stored(docs.withColumn("__place", F.monotonically_increasing_id()), "placed")
        return shard(placed, limit, id_col, text_col, step, "__place").drop("__place")
    out, depths = rows, []
    for r in table.select("word", "width").distinct().orderBy("word", "width").collect():
        p0, p1 = _entry(r["word"], r["width"])
        depths.append(name := f"__d{r['word']}_{r['width']}")
        part = table.where((F.col("word") == r["word"]) & (F.col("width") == r["width"])).select(F.col("p0").alias("__p0"), F.col("p1").alias("__p1"), F.col("depth").alias(name))
        out = out.join(part, (p0 == F.col("__p0")) & (p1 == F.col("__p1")), "left").drop("__p0", "__p1")
    bits = F.concat(F.lpad(F.bin("__h0"), BITS, "0"), F.lpad(F.bin("__h1"), BITS, "0"))
    out = out.withColumn("__depth", F.coalesce(*[F.col(d) for d in depths], F.lit(0)))
    return out.withColumn("__shard", F.substr(bits, F.lit(1), F.col("__depth"))).drop("__h0", "__h1", *depths)
