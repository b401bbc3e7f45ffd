import pytest
from oracle import same

import __spark_entry__
from lociflow.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_orders_meet_every_supplier(spark):
    from lociflow.plans import interval_queries
    from lociflow.sources.tables import table

    sf = SF.replace("0.001", "0.01")
    met = interval_queries._order_days(spark, sf, every=True).select("k").distinct().count()
    assert met == table(spark, sf, "supplier").count() > 10
