"""Every query against its SQL, over the whole of the smallest tables; queries without SQL must run."""

import pytest

from quarry import catalog
from tests.compare import differences, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, small, con):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLES:
        assert differences(df, catalog.ORACLES[name], con) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 20
