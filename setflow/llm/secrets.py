"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. A ledger table lists which blobs were scanned by
which rule in which version, and the spans found. A scan applies only the rules whose current version the ledger lacks
for a blob, reads no blob of which the ledger knows everything, appends to the ledger, and joins the spans back to all
paths with that content.

Positions are code points, the end exclusive. Defined results: null texts are empty texts; copies and repeated rows share
one blob; spans of one place are listed by kind; null paths are paths like others; an empty table scans nothing; a very
long text is scanned whole by one task, which holds that text and its spans; other columns of the input are not read, so no
name clashes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, small_batches, stored

#: (kind, version, pattern, hints, condition): fixed values. A text without any hint has no match; None: no hints.
RULES: list[tuple[str, int, re.Pattern, tuple[str, ...] | None, Callable[[re.Match], bool]]] = [
    ("assign", 1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("password", "passwd", "secret", "token", "apikey", "api_key"), lambda m: len(m[2]) >= 6),
    ("access", 1, re.compile(r"AKIA[A-Z0-9]+"), ("akia",), lambda m: len(m[0]) >= 20),
    ("hex", 1, re.compile(r"[0-9a-f]{24,}"), None, lambda m: True),
    ("pem", 1, re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("private key-----",), lambda m: True),
    ("jwt", 1, re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", re.A), ("eyj",), lambda m: True),
    ("github", 1, re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.A), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), lambda m: True),
]
BASE = ["assign", "access", "hex"]
KINDS = [r[0] for r in RULES]
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: A task remembers the hashes of at most so many blobs; what it forgets may be scanned again, with the same result.
MOST_MET = 500_000
#: Up to so many blobs that a ledger lacks, a checked number, are broadcast (about 100 bytes each) to meet their texts.
BROADCAST_BLOBS = 100_000


def spans_of(text: str, rules) -> list[tuple[str, int, int]]:
    """Spans of the given rules, in the order of the rules."""
    low, out = text.lower(), []
    for kind, _, pattern, hints, good in rules:
        if hints is None or any(h in low for h in hints):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m)]
    return out


def _scan(rules, kind: str):
    """Batches of (path, blob, rules or none, text) to (path, blob, rules, spans); spans is null where this task has met the blob before."""
    by_name = {f"{r[0]}@{r[1]}": r for r in rules}

    def run(batches):
        met: set[bytes] = set()
        for b in batches:
            blobs, names = b.column(1).to_pylist(), b.column(2).to_pylist()
            at, found, new = [0], [], []
            for k, blob in enumerate(blobs):
                new.append(blob not in met)
                if new[-1]:
                    met.add(blob)
                    found += spans_of(b.column(3)[k].as_py(), [by_name[n] for n in names[k]] if names[k] is not None else rules)
                at.append(len(found))
            if len(met) > MOST_MET:
                met.clear()
            flat = pa.StructArray.from_arrays([pa.array([s[0] for s in found], pa.string()), *[pa.array([s[k] for s in found], pa.int32()) for k in (1, 2)]], ["kind", "start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat, mask=pa.array([not x for x in new], pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), spans], ["path", "blob", "rules", "spans"])

    return run, f"path {kind}, blob binary, rules array<string>, spans {SPANS}"


def scan(versions: DataFrame, ledger: str | None = None, rules=RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``(path, blob, spans)`` for every version, and the ledger's path; without one a new ledger is made in the shared folder.

    The texts themselves are read in place and never shuffled, but for one case: more than ``BROADCAST_BLOBS`` blobs are
    not in an existing ledger. Then they alone meet their texts by a shuffle.
    """
    spark = versions.sparkSession
    fresh = ledger is None
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    run, schema = _scan(rules, rows.schema["path"].dataType.simpleString())
    names = F.array(*[F.lit(f"{r[0]}@{r[1]}") for r in rules])
    with small_batches(spark):
        if fresh:
            some = rows.select("path", "blob", F.lit(None).cast("array<string>").alias("rules"), "text")
            paths = stored(some.mapInArrow(run, schema), "paths")
            first = paths.where("spans is not null").select("blob", names.alias("rules"), "spans")
        else:
            paths = stored(rows.select("path", "blob"), "paths")
            seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            missing = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
            todo = stored(paths.select("blob").distinct().join(seen, "blob", "left").select("blob", missing.alias("rules")).where("size(rules) > 0"), "todo")
            n = todo.count()
            met = rows.join(F.broadcast(todo) if n <= BROADCAST_BLOBS else todo, "blob").select("path", "blob", "rules", "text")
            first = met.mapInArrow(run, schema).where("spans is not null").select("blob", "rules", "spans") if n else None
        if first is not None:  # copies in other tasks were scanned there too
            first.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("spans").alias("spans")).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger)
    tags = F.create_map(*[F.lit(x) for r in rules for x in (r[0], f"{r[0]}@{r[1]}")])
    current = F.filter("spans", lambda s: F.array_contains("rules", tags[s["kind"]]))
    found = found.select("blob", current.alias("spans")).where("size(spans) > 0")
    if not fresh:  # one row per scan of a blob; stored, so that the join below has plain shuffles, whose large partitions Spark can split
        discard(todo)
        found = stored(found.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    out = paths.select("path", "blob").join(found, "blob", "left")
    return out.select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), ledger


def read_ledger(spark, ledger: str) -> DataFrame:
    return spark.read.schema(f"blob binary, rules array<string>, spans {SPANS}").parquet(ledger)


def joined(spans, kinds: list[str] = KINDS):
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in kinds])
    some = F.filter(spans, lambda s: F.array_contains(order, s["kind"]))
    keyed = F.array_sort(F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
