"""A corpus pipeline in stages, each written as Parquet and reread by the next.

Language ID drops documents without a recognisable language; near-duplicate groups keep one document (five-word
shingles, similarity 0.8 or more); documents that hold a benchmark passage go; sources are mixed to target weights;
what is left gets its shard.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.llm import decontam, langid, mixing, neardup, sharding
from setflow.llm.common import discard, fresh, read, scratch, stored

#: Documents whose language is less probable than this are rejected, as are those without any letter.
LEAST_LANGUAGE = 0.5


def shielded(stage):
    """A stage whose input columns that start with two underscores, as the operators' own do, have other names meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                hidden[c] = fresh([*docs.columns, *hidden.values()], f"kept{c}")
        return stage(spark, docs.withColumnsRenamed(hidden), sf_dir).withColumnsRenamed({v: k for k, v in hidden.items()})

    return run


@shielded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognisable language; trained on this stage's own labelled documents.

    Rejected are null and empty texts, texts without a letter, and those whose best language has a probability under
    ``LEAST_LANGUAGE`` (a tie of two stays). Without any label nothing is recognised and nothing stays. Labels may be null; very
    long texts are scored whole; repeated rows are judged alike; an empty table stays empty; other columns pass, whatever their names.
    """
    found = langid.identify(docs, langid.train(docs))
    return found.where((F.col("__lang") != "und") & (F.col("__lang_score") >= LEAST_LANGUAGE)).select(*docs.columns)


@shielded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Rows with a null id are in no group and stay, as do texts without words. Rows that share an id are one document: all its texts stay
    or go together, but of rows that agree in id and text one stays, any of them. Very long texts are compared whole; an
    empty table stays empty; other columns pass, whatever their names.
    """
    found = neardup.near_duplicates(docs, width=5, percent=80).where("kept")
    keep = stored(found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")), "keep")
    one = keep.where("__n = 1 or __id is null").select("__id")
    out = docs.join(one, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    many = stored(keep.where("__n > 1 and __id is not null").select("__id"), "many")
    if many.isEmpty():
        return out
    return out.unionByName(docs.join(many, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "text"]))


@shielded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of ten words (or a whole item, where that is shorter).

    Null and empty texts hold none and stay. Rows that share an id, or have none, are judged by their own text; repeated rows alike;
    very long texts whole. An empty benchmark takes nothing away; an empty table stays empty; other columns pass, whatever their names.
    """
    found = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), width=10)
    dirty = found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__th"))
    return docs.join(stored(dirty, "dirty"), same, "left_anti")


@shielded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source of its own, the last. Null and empty texts have size 0 and are taken as often as the whole copies of
    their class say; null ids are ranked by their text; of rows that agree in id and text as many are taken as fit; a very long
    text is a document like others. An empty table stays empty; other columns pass, whatever their names.
    """
    return mixing.mixed_rows(mixing.mix(docs, [3.0, 1.0, 2.0], 1.5), docs.columns)


@shielded
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their bytes, ``n_bytes``, and their shard's bits, ``shard``; input columns of these two names are replaced.

    Null and empty texts have 0 bytes and a shard. Rows that share an id, or have none, part on their places if they exceed the
    limit together; a text longer than the limit is alone in its shard. An empty table has no shards; other columns pass.
    """
    s = sharding.shard(docs, 16 << 20)
    return s.select(*[c for c in docs.columns if c.lower() not in ("n_bytes", "shard")], F.col("__bytes").alias("n_bytes"), F.col("__shard").alias("shard"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]
#: Language scores are not expressible in SQL; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of each only its result is left in the shared folder, and of that only what the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            out = stored(stage(spark, docs, sf_dir), name)
            keep.append(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
