import pytest
from orrery.plans import catalog, catalog_named  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(against_sql, name):
    against_sql(catalog.QUERIES[name], catalog.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
