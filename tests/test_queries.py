"""Every registered query against its SQL on the smallest driver tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF)


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    text, _, fine = compare(spark, duck, name, queries()[name], oracle_sql().get(name), SF)
    assert fine, text


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["shard_id", "tokens", "examples", "sources"]
    assert rows.count() > 0
