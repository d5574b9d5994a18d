"""Every query with SQL gives the same rows on the smallest tables."""

import pytest
from tests.harness import connection, difference

from strataq.plans import registry

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALLEST)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_rows(name, spark, con):
    df = registry.QUERIES[name](spark, SMALLEST)
    if name in registry.ORACLES:
        assert difference(df, con, registry.ORACLES[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
