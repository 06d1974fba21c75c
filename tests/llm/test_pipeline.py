"""The queries of the operators and the pipeline on the given tables."""

import corpus_pipeline
import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from grainsift.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    found = entry.queries()
    assert "pipeline" in found
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) <= set(found)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF))
        ids.append({r["doc_id"] for r in out.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if name != "sharding":
            assert out.columns == docs.columns
            docs = out
    assert out.count() == docs.count() and "shard" in out.columns
    assert len(ids[3]) < len(ids[0]) and len(ids[3]) > 0.5 * len(ids[0])


def test_pipeline_stages_take_odd_rows(spark, edge_docs, tmp_path):
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it at all in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge_docs, edge_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
            if name != "sharding":
                assert out.columns == edge_docs.columns
                docs = out
        assert out.count() == docs.count()
