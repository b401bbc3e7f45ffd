import pytest
from oracle import same

from lociflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.01")
