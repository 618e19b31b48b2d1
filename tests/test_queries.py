"""Every registered query against its SQL, on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect
from treeloom.plans import catalog, oracle

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(catalog.QUERIES) == set(oracle.SQL)


def test_an_emptied_query_fails(spark, con, sf_dir):
    empty = lambda s, d: QUERIES["extension_stats"](s, d).limit(0)
    _, _, problem = check(spark, con, sf_dir, "extension_stats", empty, SQL["extension_stats"])
    assert problem.startswith("rows 0 != ")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    _, _, problem = check(spark, con, sf_dir, name, QUERIES[name], SQL[name])
    assert problem is None or problem == "no rows"


def test_entry(spark):
    assert entry.entry(spark).columns == ["directory", "file_count", "total_size"]


def test_functions_are_shipped_with_the_job():
    from pyspark import cloudpickle

    assert "treeloom" in cloudpickle.list_registry_pickle_by_value()
