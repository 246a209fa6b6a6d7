"""The driver's contract: flagship query and every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
from exposight.verification.oracles import oracles
from exposight.verification.registry import QUERIES
from exposight.verification.views import TABLES, VIEWS, spark_view
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
# Run in their own test modules as well; here they would only repeat slow set-up.
SLOW = {"svm_train_eval", "stream_analyse", "stream_dedup"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_match():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(QUERIES) == set(oracles()) and set(QUERIES) <= set(queries)
    assert not set(VIEWS) & set(TABLES)


def test_every_document_is_a_page_text(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    texts = spark_view(spark, SF, "page_texts")
    assert texts.count() == documents.count()
    assert documents.join(texts, documents["doc_id"] == texts["page_id"], "left_anti").count() == 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["page_id", "subject_id", "n_findings", "risk_score"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, contract.queries()[name], contract.oracle_sql().get(name))
    assert ok, note
