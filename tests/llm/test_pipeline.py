"""The pipeline stage by stage against plain Python, and the queries with SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_free import brute_components
from test_native import brute_decontaminate

import corpus_pipeline as pipe
from setflow.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    table = "pages" if name.startswith("op3") else "documents"
    assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in q.ORACLE_SQL:
        con = duckdb.connect()
        for f in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        want = con.execute(q.ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns) and sorted(map(repr, got[cols].astype(object).values.tolist())) == sorted(map(repr, want[cols].astype(object).values.tolist()))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 56", None, None, 8), (10**6 + 1, None, None, "src0", None), (None, "the thing and other words here", "en", "src0", 5)], docs.schema)
    docs = docs.unionByName(extra)
    steps = dict(pipe.STAGES)
    langs = steps["language_id"](spark, docs, SF)
    kept = {r["doc_id"] for r in langs.collect()}
    assert {r["doc_id"] for r in docs.collect()} - kept == {10**6, 10**6 + 1}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in langs.collect()]
    near = steps["near_dedup"](spark, langs, SF)
    want = {i for i, c in brute_components(rows, 5, 80).items() if i == c} | {None}
    assert {r["doc_id"] for r in near.collect()} == want and near.columns == docs.columns
    rows = [(r["doc_id"], r["text"], r["source"]) for r in near.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = steps["decontaminate"](spark, near, SF)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _, _, _, dirty in brute_decontaminate(rows, items) if not dirty}
    mixed = steps["mix_sources"](spark, clean, SF)
    copies = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed.columns == docs.columns and copies == 2
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.02 * words(clean)
    final = steps["shard"](spark, mixed, SF)
    assert final.count() == mixed.count() and final.columns == [*docs.columns, "n_bytes", "shard"]


def odd_documents(spark):
    """Repeated rows, nulls, one id with two texts, and columns named like those of the operators."""
    text = "the thing and other words that are here for all of us to read"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + " now", "en", "a"), (None, text, "en", None), (None, None, None, None), (5, "", "en", "b"), (6, "quite something else stands here, 12 words or not", "en", "b"), (6, "and this is another text under the same id", "en", "b")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("__lang", "__id", "__mix_in", "__h0", "__bytes", "th", "shard", "N_BYTES", "__n", "kept__n")})


def test_stages_with_odd_rows(spark):
    docs = odd_documents(spark)
    steps = dict(pipe.STAGES)
    for name, stage in pipe.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and (name == "shard" or none.columns == docs.columns)
    langs = steps["language_id"](spark, docs, SF)
    assert langs.columns == docs.columns and langs.count() == 6 and langs.first()["__lang"] == "x"
    near = steps["near_dedup"](spark, docs, SF)
    assert near.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=repr) == sorted({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 2}, key=repr)
    clean = steps["decontaminate"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == 8
    mixed = steps["mix_sources"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.where("__mix_in = 'x'").count() == mixed.count() > 0
    final = steps["shard"](spark, docs, SF)
    assert final.columns == [c for c in docs.columns if c not in ("shard", "N_BYTES")] + ["n_bytes", "shard"] and final.count() == 8
    assert {r["__h0"] for r in final.collect()} == {"x"}


def test_run(spark):
    assert [n for n, _ in pipe.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    assert pipe.run(spark, SF).count() > 0
