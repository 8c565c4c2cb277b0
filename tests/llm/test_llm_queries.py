"""The registered queries on the smallest tables: against SQL where there is some, else by their contracts."""

import __spark_entry__ as entry_module
import corpus_pipeline
import oracle
import pytest
from conftest import SMALL
from helpers import awkward, jaccard_classes, SCHEMA

from threadloom.llm import language_id
from threadloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, oracle_con):
    assert oracle.differences(QUERIES[name](spark, SMALL), oracle_con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_whitening"}))
def test_query_has_a_row_per_document(name, spark):
    rows = QUERIES[name](spark, SMALL).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(rows))) and len(rows) == 200


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_module.queries())
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [
        f"op{i}" for i in range(1, 14)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    found = language_id.identify(docs, language_id.fit_on_documents(docs)).where(language_id.held_out())
    right = [r.lang == r.lang_pred for r in found.select("lang", "lang_pred").collect()]
    assert len(right) > 250 and sum(right) > 0.97 * len(right)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        docs = corpus_pipeline.stage_table(stage(spark, docs, SMALL), "pipeline-test")
        if name == "jaccard_join":
            found = jaccard_classes([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in docs.collect()} == {c for _, c, _ in found.values()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.count()
        if name in ("pii", "byte_bpe"):
            assert docs.count() == before.count()


def test_pipeline_on_awkward_documents(spark, tmp_path):
    for rows in (awkward(), []):
        folder = str(tmp_path / f"docs{len(rows)}")
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        assert (corpus_pipeline.run(spark, folder).count() > 0) == bool(rows)
