import pytest

from lucerna.llm.registry import ORACLES, QUERIES

from ..oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], ORACLES[name])
