import pytest

import __spark_entry__ as entry
from pairsmith.plans import registry
from conftest import SF

ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
