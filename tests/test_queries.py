"""Every catalog query against its SQL over the smallest tables."""

import pytest

from entigraph.plans import catalog
from tests.compare import database, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF, db) == ""
