import pytest
from compare import connection, same

from specmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf).toPandas(), connection(sf).sql(catalogue.ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_page_parse(spark, sf):
    assert catalogue.QUERIES["page_parse"](spark, sf).count() == 50
