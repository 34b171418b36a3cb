"""Every query with SQL gives DuckDB's rows; the others run and give rows; the entry has the contract's shape."""

import pytest
from conftest import DATA, duck, plain

import __spark_entry__ as entry
from postwarden.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert plain(registry.QUERIES[name](spark, DATA).toPandas()) == duck(registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
