import glob
import os
import shutil

import duckdb
import pytest

import corpus_pipeline
from ordermill.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    cursor = con.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in result.collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_license_scan", "op6_best_fit_packing", "op7_quality", "op9_token_counts"])
def test_every_document_has_a_row(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in queries.QUERIES[name](spark, SF_DIR).select("doc_id").collect()} == ids


def test_stages_narrow_the_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns
        path = str(tmp_path / name.replace(" ", "-"))
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and len(after) > len(before) / 2
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_odd_documents_pass_all_stages(spark, tmp_path):
    """Nulls, empty texts and extra columns; the other tables empty."""
    rows = [(None, None, 1.0, "a"), (1, None, 1.0, "a"), (2, "", None, None), (3, "some plain words of text", 0.0, "b"), (3, "some plain words of text", 0.0, "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string, score double, item_id string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r.doc_id, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == [(1, 0), (2, 0), (3, 5), (None, 0)]
    shutil.rmtree(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
