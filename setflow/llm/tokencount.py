"""Token counts by a separator scan of flat token files.

Writing: each task turns its texts into one endless sequence of token ids, every text followed by the
end-of-document id, and cuts it into blocks of fixed size without regard to texts. A stream has no index. The blocks are
rows of a stored table, which the scan reads as it would read blocks of a file, so that they survive lost executors.
Scanning: every block is searched for separators in one vectorised comparison. Documents that cross blocks are
put together by a prefix scan over block summaries (separators in the block, place of the last one): a running sum of
separators numbers the documents, a running maximum of separator positions gives where each block's first document began.
The separators themselves stay with their block and meet its two numbers by a join on stream and block.

A stream of our own is the output of one task, so its blocks are bounded by a task's input; a stream of any other origin is
a file of any size, read block by block. The prefix scan orders one short row per block.

Defined results: null and empty texts have 0 tokens; repeated rows each count; a stream whose last document has no
separator reports it as not closed; an empty table gives no streams and no counts; very long texts are encoded in
pieces and run over as many blocks as they need. Ids may be of any type; only id and text are read, so no name clashes.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, stored

#: The usual file of merge ranks; a parameter, read by the driver only.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to those ranks - fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18
#: Longer texts are encoded piece by piece, cut before white space; it bounds memory and does not change ids.
PIECE = 1 << 20


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    e = tiktoken.Encoding("setflow", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if len(text) <= PIECE:
            return e.encode_ordinary(text)
        out, at = [], 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not (text[end] == " " and text[end - 1].isalnum()):
                end += 1
            out += e.encode_ordinary(text[at:end])
            at = end
        return out

    return ids


def write_streams(docs: DataFrame, ranks: dict[bytes, int], separator: int = SEPARATOR, block: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows of two kinds: blocks ``(stream, block, tokens)`` of little-endian ids, and the manifest ``(stream, place, doc_id)``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = np.dtype("<u2" if separator < 1 << 16 and max(ranks.values(), default=0) < 1 << 16 else "<u4")

    def run(batches):
        from pyspark import TaskContext

        stream, ids = TaskContext.get().partitionId(), encoder(shared.value)
        place, number, held = 0, 0, np.empty(0, kind)

        def rows(numbers, blobs, places, names, id_type):
            n, m = len(numbers), len(places)
            return pa.RecordBatch.from_arrays(
                [pa.array([stream] * (n + m), pa.int32()), pa.array([*numbers, *[None] * m], pa.int32()), pa.array([*blobs, *[None] * m], pa.binary()), pa.array([*[None] * n, *places], pa.int64()), pa.array([*[None] * n, *names], id_type)],
                ["stream", "block", "tokens", "place", "doc_id"],
            )

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [held]
                for t in part.column(1).to_pylist():
                    got.append(np.array([*ids(t or ""), separator], kind))
                held = np.concatenate(got)
                cut = len(held) // block
                blobs = [held[k * block : (k + 1) * block].tobytes() for k in range(cut)]
                yield rows(range(number, number + cut), blobs, range(place, place + part.num_rows), part.column(0).to_pylist(), id_type)
                held, number, place = held[cut * block :].copy(), number + cut, place + part.num_rows
        if len(held):
            yield rows([number], [held.tobytes()], [], [], id_type)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        return stored(rows.mapInArrow(run, f"stream int, block int, tokens binary, place long, doc_id {rows.schema['doc_id'].dataType.simpleString()}"), "tokens")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks ``(stream, block, tokens)`` of flat token files of any other origin; a stream is a file.

    Only names and lengths of the files are listed; each block is read by the task that scans it, at its place in the
    file, where pyarrow can open the store. Stores that only Spark reads are read file by file, each held by one task.
    """
    from pyarrow import fs

    files, size = spark.read.format("binaryFile").load(path), width * block
    blocks = F.explode(F.expr(f"sequence(0, cast((greatest(length, 1) - 1) div {size} as int))")).alias("block")
    first = files.select("path").first()
    if first is None:
        return spark.createDataFrame([], "stream string, block int, tokens binary")
    try:
        fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", first["path"]))[0].get_file_info(fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", first["path"]))[1])
    except (pa.ArrowException, OSError, ValueError):
        rows = files.select(F.col("path").alias("stream"), "content", blocks)
        return rows.select("stream", "block", F.expr(f"substring(content, block * {size} + 1, {size})").alias("tokens"))

    def run(batches):
        for b in batches:
            for name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with store.open_input_file(at) as f:
                    f.seek(k * size)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([f.read(size)], pa.binary())], ["stream", "block", "tokens"])

    # dealt anew by block: else one task would read all blocks of the files it listed
    places = files.select(F.col("path").alias("stream"), blocks).repartition("stream", "block")
    return places.mapInArrow(run, "stream string, block int, tokens binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """``stream, place, n_tokens, closed``: the token count of every document of every stream."""
    kind = np.dtype(f"<u{width}")
    stream = blocks.schema["stream"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ends, sizes = [], []
            for t in b.column(2):
                x = np.frombuffer(t.as_py(), kind)
                ends.append(np.nonzero(x == separator)[0].astype(np.int64)), sizes.append(len(x))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ends)]), pa.int32()), pa.array(np.concatenate(ends) if ends else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat, pa.array(sizes, pa.int64())], ["stream", "block", "ends", "size"])

    with small_batches(blocks.sparkSession):
        found = blocks.select("stream", "block", "tokens").mapInArrow(run, f"stream {stream}, block int, ends array<long>, size long")
        found = stored(found.withColumn("ends", F.transform("ends", lambda e: e + F.col("block").cast("long") * block)), "ends")
    order = Window.partitionBy("stream").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("stream", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("end"), (F.col("block").cast("long") * block + F.col("size")).alias("tail"))
    sums = sums.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).withColumn("last", F.coalesce(F.max("end").over(before), F.lit(-1).cast("long")))
    final = F.lead("block").over(order).isNull()
    sums = sums.withColumn("open", F.when(final & (F.coalesce("end", "last") < F.col("tail") - 1), F.col("tail")))
    sums = stored(sums.select(F.col("stream").alias("s"), F.col("block").alias("k"), "n_before", "last", "open"), "sums")
    found = found.join(sums, (F.col("stream") == F.col("s")) & (F.col("block") == F.col("k")))
    stops = F.concat(F.transform("ends", lambda e: F.struct(e.alias("at"), F.lit(True).alias("closed"))), F.when(F.col("open").isNotNull(), F.array(F.struct(F.col("open").alias("at"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<at:long,closed:boolean>>")))
    rows = found.select("stream", "n_before", "last", F.col("ends"), F.posexplode(stops).alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("last")).otherwise(F.try_element_at("ends", F.col("k")))
    return rows.select("stream", (F.col("n_before") + F.col("k")).alias("place"), (F.col("stop.at") - start - 1).alias("n_tokens"), F.col("stop.closed").alias("closed"))


def token_counts(docs: DataFrame, ranks: dict[bytes, int] | None = None, separator: int = SEPARATOR) -> DataFrame:
    """``doc_id, n_tokens`` for every row, counted in the written streams."""
    ranks = ranks or load_ranks()
    rows = write_streams(docs, ranks, separator)
    width = 2 if separator < 1 << 16 and max(ranks.values()) < 1 << 16 else 4
    counts = scan(rows.where("tokens is not null"), separator, width)
    places = stored(rows.where("place is not null").select("stream", "place", "doc_id"), "places")
    discard(rows)
    return places.join(counts, ["stream", "place"]).select("doc_id", "n_tokens")
