"""Registered queries against their SQL on the smallest data set, and plan shapes."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from convoy.plans.oracle import ORACLES
from convoy.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
# Fitted models need more rows than the smallest data set has; check.py runs them on the next one.
FITTED = {"train_classifier", "train_ttf_basic", "train_ttf_temporal", "score_hybrid"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_query_equals_its_sql(spark, con, name):
    assert check.compare(spark, con, name, SF).startswith("ok")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_scanned_once_and_reduced_before_the_shuffle(spark):
    found = plan(entry.queries()["features_temporal"](spark, SF)).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in found and found.count("FileScan") == 1
    assert "CartesianProduct" not in found and "NestedLoop" not in found and "SinglePartition" not in found
    assert "PushedFilters: [IsNotNull(ts)]" in found


@pytest.mark.parametrize("name", ["route_geometry", "snap_nodes", "series_backfill_strict", "stratified_split", "shortest_paths"])
def test_no_cross_joins(spark, name):
    found = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in found and "NestedLoop" not in found


def test_constant_time_bounds_reach_the_scan(spark):
    found = plan(entry.queries()["fleet_status"](spark, SF))
    assert "GreaterThanOrEqual(ts,2024-01-29T22:26:30)" in found


@pytest.mark.parametrize("name", ["training_features", "features_temporal", "telemetry_slice_agg"])
def test_points_are_aggregated_by_hashing(spark, name):
    """A sort aggregate may only stand above an exchange, where the points are slices already."""
    found = plan(entry.queries()[name](spark, SF)).split("== Initial Plan ==")[0]
    scan = found.index("FileScan")
    below = found[found.rindex("Exchange hashpartitioning(", 0, scan) : scan]
    assert "HashAggregate" in below and "SortAggregate" not in below
