import pytest
from conftest import DATA

from siltstone.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in SQL])
def test_agrees_with_sql(agree, name):
    agree(catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", ["fts_search", "stream_ingest_available_now"])
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
