"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from siteaudit.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck, rows_of):
    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        assert got.count() >= 0
        return
    assert rows_of(got) == rows_of(duck.execute(registry.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
