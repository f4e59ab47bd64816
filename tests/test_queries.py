"""Every registered query with SQL against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from quillon.plans import entries
from quillon.plans.views import FEATURES
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same(entries.QUERIES[name](spark, SF), duck, entries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(entries.QUERIES) - set(entries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert entries.QUERIES[name](spark, SF).count() > 0


def test_aggregates_take_every_feature(spark):
    assert set(FEATURES) < set(entries.QUERIES["g10_aggregate_features"](spark, SF).columns)
    assert {r["feature"] for r in entries.QUERIES["g11_aggregate_multistat"](spark, SF).select("feature").distinct().collect()} == set(FEATURES)


@pytest.mark.parametrize("name", ["g10_aggregate_features", "g11_aggregate_multistat"])
def test_aggregates_match_sql_where_means_tie(spark, name):
    d, c = SF.replace("0.001", "0.01"), duckdb.connect()
    for table in os.listdir(d):
        c.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{d}/{table}'")
    same(entries.QUERIES[name](spark, d), c, entries.ORACLE_SQL[name])
