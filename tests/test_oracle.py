"""Every query that has SQL gives the rows of its SQL."""

import pytest
from compare import assert_same, connect

from telesift.plans import catalog, streams  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, sf, con, key):
    assert_same(catalog.QUERIES[key](spark, sf), catalog.ORACLE_SQL[key], con)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
