import pytest

import __spark_entry__ as entry
from lucerna.plans import catalogue, coverage  # noqa: F401

from .oracle import same


#: Queries that need more labelled rows than the smallest tables have.
LARGER = {"e_semantic_query"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_and_sql_agree(spark, sf_dir, name):
    same(spark, sf_dir.replace("sf0.001", "sf0.01") if name in LARGER else sf_dir, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id"]
