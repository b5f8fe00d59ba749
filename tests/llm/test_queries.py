"""The registered queries on the driver's tables: shape, contract, and SQL where there is any."""

import zlib

import pytest
from conftest import same

import corpus_pipeline
from cohortis.llm import common, queries

COLUMNS = {
    "op1_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7_ann": ["query_id", "rank", "vec_id", "score"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    if name in queries.ORACLES:
        same(df, duck.sql(queries.ORACLES[name]))
    elif name != "op7_ann":
        n = duck.sql("select count(*) from documents").fetchall()[0][0]
        assert df.count() == n


def test_held_out(spark, data):
    got = queries.op3_toxicity(spark, data).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_pipeline_is_its_stages(spark, data):
    docs = queries.table(spark, data, "documents")
    columns = docs.columns
    left = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, data), name)
        n = docs.count()
        assert 0 < n <= left and (docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1)
        left = n
    got = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == got


def test_no_cartesian_products(spark, data):
    for name in ("op4_url_filter", "op5_sharding", "op9_simhash"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = queries.op4_url_filter(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
