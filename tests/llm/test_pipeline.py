"""The corpus pipeline stage by stage, and the registered queries."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hearthlens.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered_queries_and_contract():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    q = entry.queries()
    assert set(queries.QUERIES) <= set(q) and q["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in entry.oracle_sql() and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = docs.where("length(text) > 1500 and lang = 'en'").orderBy("doc_id").first()["text"]
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(9001, base, "en", "p", 1), (9002, near, "en", "p", 1), (9003, "123 456 !!", None, "p", 1), (9004, None, None, None, None),
            (9005, "The start of the other one that was. " + bench + " And then of the end it is.", "en", "p", 1), (None, "And the other of them was not in the house that is to be.", "en", None, None)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_pipeline_stages_take_effect(spark):
    docs = planted(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == before.columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
    assert not {9003, 9004} & seen["language_id"] and {9001, 9002, 9005, None} <= seen["language_id"]
    assert 9001 not in seen["line_dedup"]  # all its lines are in the document it copies
    assert 9005 in seen["near_duplicates"] and 9005 not in seen["decontamination"]
    assert seen["packing"] == seen["decontamination"] and None in seen["packing"]


def test_near_duplicate_stage_keeps_one_of_a_group(spark):
    docs = planted(spark)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert not {9001, 9002} & kept and {9003, 9004, 9005, None} <= kept


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("key", ["op2_lm_score", "op3_language_id", "op7_packing", "op8_ngram_join", "op9_fingerprints", "op10_line_dedup", "op1_license_scan"])
def test_queries_cover_all_documents(spark, key):
    got = collections.Counter(r["doc_id"] for r in queries.QUERIES[key](spark, SF).collect())
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert set(got) == ids and (key == "op7_packing" or max(got.values()) == 1)


def test_warc_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    res = con.execute(queries.ORACLES["op4_warc"])
    names = [d[0] for d in res.description]
    got = queries.QUERIES["op4_warc"](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(res.fetchall(), key=str)


def test_language_query_contract(spark):
    df = queries.QUERIES["op3_language_id"](spark, SF)
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    assert df.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
