"""Every registered query equals its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import check
from oracle_sql_pack import registry as sql_registry
from wareloom.plans import registry

QUERIES, SQL = registry.all_queries(), sql_registry.all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, folder, name):
    assert check(spark, duck, folder, name, QUERIES[name], SQL[name]) == ""


def test_registries_match():
    assert set(SQL) == set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["store_key", "store_name", "city", "total_revenue"]
    assert df.count() == 10
