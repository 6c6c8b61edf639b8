"""Queries that have SQL agree with it; the others give a row for each row or document."""

import pytest
from compare import differences

from tidemark.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    assert differences(spark, registry.QUERIES, registry.ORACLE_SQL, SMALL, [name]) == {}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"op3_repeated_passages", "op13_packing"}))
def test_query_covers_all_documents(spark, name):
    docs = {r.doc_id for r in registry.table(spark, SMALL, "documents").select("doc_id").collect()}
    got = [r.doc_id for r in registry.QUERIES[name](spark, SMALL).select("doc_id").collect()]
    assert len(got) == len(docs) and set(got) == docs
