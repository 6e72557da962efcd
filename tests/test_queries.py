import pytest

from paperloom import catalogue
from tests.compare import both, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours, theirs = both(spark, duck, catalogue.QUERIES[name], catalogue.SQL[name], SF)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_module_names_all_queries(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
