"""Every registered query against its SQL; those without SQL must give rows."""

import pytest

from boxlore import catalog
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert result.startswith(("ok", "rows=")), result


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
