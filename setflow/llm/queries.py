"""Queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, mixing, neardup, ogg, oracles, secrets, sharding, tokencount, urlgbt
from .common import read, scratch

MIX_WEIGHTS, MIX_SHARE, MIX_COPIES = [3.0, 1.0, 2.0], 1.5, 2.0
SHARD_BYTES = 16 << 20


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__lang_score").alias("score"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = urlgbt.judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return j.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.col("__score").alias("score"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_COPIES)
    return m.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_total").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ogg.read_media(ogg.write_media(read(spark, sf_dir, "documents")))
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch(spark):
        _, ledger = secrets.scan(docs)
    found, _ = secrets.scan(docs, ledger)  # the second scan finds every blob in the ledger and reads none
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.BASE]
    base = F.sha2(secrets.joined(F.col("spans"), secrets.BASE).cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("path").alias("doc_id"), *count, base, secrets.joined(F.col("spans")).alias("spans"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return s.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__depth").alias("depth"), F.col("__shard").alias("shard"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("licenses", ",").alias("licenses"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_langid, op3_urls, op4_mix, op5_ogg, op6_tokens, op7_neardup, op8_secrets, op9_shard, op10_licenses)}
#: The others have a learned model, a media container, a tokenizer or match positions, which SQL lacks; they are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracles.decontamination(10),
    "op4_mix": oracles.mixture(MIX_WEIGHTS, MIX_SHARE, MIX_COPIES),
    "op7_neardup": oracles.near_duplicates(80),
    "op9_shard": oracles.shards(SHARD_BYTES),
    "op10_licenses": oracles.license_scan(),
}
