"""Every registered query that has SQL, against DuckDB; the others run and give rows."""

import pytest
from compare import connect, difference

from quantloom.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, con, name):
    assert not difference(spark, con, registry.queries()[name], ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.count() > 0 and len(df.columns) > 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not entry.entry(spark).isEmpty()
