"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import pytest

import chalkline.plans  # noqa: F401
from chalkline import registry
from tests.compare import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = con.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
