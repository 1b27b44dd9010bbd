"""Every query of the library against its SQL on the smallest tables; those without SQL run and give rows."""

import pytest

from folioscope import catalog
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert difference(df, con, sql) is None
    else:
        assert df.count() > 0
