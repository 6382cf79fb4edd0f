import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.plans.scratch import cut

TABLES = "documents pages labels benchmark".split()


def plain(rows, names):
    order = sorted(names)
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([text(r[names.index(n)]) for n in order] for r in rows)


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op9_warc", "op10_mixing"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf_dir)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_the_eleven_queries_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_stages_keep_the_columns_and_shrink(spark, sf_dir):
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = cut(stage(spark, docs, sf_dir), "test")
        if k < 3:
            assert docs.exceptAll(before).count() == 0
        if k < 4:
            assert docs.dtypes == first.dtypes
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_stages_take_edge_rows(spark, sf_dir, null_key_docs, no_docs, clashing_docs):
    for docs in (null_key_docs, no_docs, clashing_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert out.count() >= 0
            assert k == 4 or out.columns == docs.columns


def test_op_queries_run_on_the_smallest_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_sharding", "op4_near_dedup", "op5_fingerprints", "op6_substring_dedup", "op7_toxicity", "op8_token_files"):
        assert __spark_entry__.queries()[name](spark, sf_dir).count() == n, name
    assert os.path.exists(corpus_pipeline.__file__)
