"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from attestra import catalogue
from tests.same import connect, rows


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, folder, con, name):
    found = catalogue.queries()[name](spark, folder).toPandas()
    said = con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(said.columns)
    assert rows(found) == rows(said)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, folder, name):
    assert catalogue.queries()[name](spark, folder).count() >= 0
