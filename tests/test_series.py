import random

import pytest
from pyspark.sql import functions as F

from convoy.operators import series, state
from convoy.schemas import BASELINE_SEED, FAILURE_CONFIG, MARKERS, OVERRIDE_SEED
from convoy.settings import Clock

NE = 10
LENGTHS = {"ENGINE": 8, "TRANSMISSION": 30, "ELECTRICAL": 30}


@pytest.fixture(scope="module")
def clock(at):
    return Clock(at(0), NE)


@pytest.fixture(scope="module")
def baseline(spark):
    return spark.createDataFrame([(e, i, float(i), 0.0, 0.0) for e in "abcdefgh" for i in range(1, 31)], BASELINE_SEED)


@pytest.fixture(scope="module")
def overrides(spark):
    data = [(t, i, 1000.0 + i, float(len(t)), 0.0) for t, n in LENGTHS.items() for i in range(1, n + 1)]
    return spark.createDataFrame(data, OVERRIDE_SEED)


def configs(spark, data):
    """(entity, type, enabled, effective, cursor)"""
    return spark.createDataFrame(data, FAILURE_CONFIG)


def markers(spark, at, data):
    return spark.createDataFrame([(e, at(0), "X", at(0), b) for e, b in data], MARKERS)


def readings(df):
    return sorted((r.entity_id, int((r.ts.minute * 60 + r.ts.second) / 5), r.engine_temp) for r in df.collect())


def test_step_rules(spark, at, clock, baseline, overrides):
    config = configs(
        spark,
        [
            ("a", "ENGINE", True, NE + 1, None),  # starts right now, null cursor
            ("b", "ENGINE", True, NE + 2, 0),  # not yet
            ("c", "ENGINE", True, 1, 8),  # exhausted
            ("d", "COOLANT", True, 1, 0),  # unknown type
            ("e", "ENGINE", False, 1, 0),  # off
            ("f", "ENGINE", True, 1, 3),  # broken down
        ],
    )
    broken = markers(spark, at, [("f", NE + 1), ("g", NE + 1), ("g", NE + 5), ("h", NE + 2)])
    found = readings(series.series_step(baseline, overrides, config, broken, clock, NE + 1))
    assert found == [("a", NE + 1, 1001.0), ("b", NE + 1, 11.0), ("e", NE + 1, 11.0), ("h", NE + 1, 11.0)]


def test_backfill_batch_rules(spark, clock, baseline, overrides):
    config = configs(
        spark,
        [
            ("a", "ENGINE", True, NE + 3, 5),  # later start; runs out after three rows
            ("b", "COOLANT", True, None, None),  # electrical stands in
            ("c", "ENGINE", True, NE + 50, 0),  # beyond the range: emits nothing at all
            ("d", "ENGINE", False, 1, 0),
        ],
    )
    found = readings(series.series_backfill(baseline.filter("entity_id < 'e'"), overrides, config, clock, 6))
    assert [r for r in found if r[0] == "a"] == [("a", NE + 3 + i, 1006.0 + i) for i in range(3)]
    assert [r for r in found if r[0] == "b"] == [("b", NE + 1 + i, 1001.0 + i) for i in range(6)]
    assert [r for r in found if r[0] == "c"] == []
    assert [r for r in found if r[0] == "d"] == [("d", NE + 1 + i, 11.0 + i) for i in range(6)]


@pytest.mark.parametrize("seed", [1, 2])
def test_strict_backfill_equals_repeated_steps(spark, at, clock, baseline, overrides, seed):
    rnd = random.Random(seed)
    config = configs(
        spark,
        [
            (e, rnd.choice([*LENGTHS, "COOLANT"]), rnd.random() < 0.8, rnd.choice([None, 5, NE + 1, NE + 3, NE + 9]), rnd.choice([None, 0, 4, 7, 100]))
            for e in "abcdef"
        ],
    )
    broken = markers(spark, at, [("a", NE + 2), ("b", NE + 4), ("b", NE + 3), ("g", 4), ("h", None)])
    n = 5
    stepped, current = [], config.collect()
    for epoch in range(NE + 1, NE + 1 + n):
        now = spark.createDataFrame(current, FAILURE_CONFIG)
        stepped += readings(series.series_step(baseline, overrides, now, broken, clock, epoch))
        current = state.cursor_advance_step(now, overrides, epoch).select(*config.columns).collect()
    whole = readings(series.series_backfill_strict(baseline, overrides, config, broken, clock, n))
    assert whole == sorted(stepped)


def test_cursor_advance(spark, overrides, rows):
    config = configs(
        spark,
        [
            ("a", "ENGINE", True, NE + 1, None), ("b", "ENGINE", True, NE + 2, 3), ("c", "ENGINE", True, 1, 8),
            ("d", "COOLANT", True, 1, 0), ("e", "ENGINE", False, 1, 0), ("f", "ENGINE", True, None, 2),
        ],
    )
    columns = ["entity_id", "failure_next_epoch"]
    step = state.cursor_advance_step(config, overrides, NE + 1)
    assert rows(step, *columns) == [("a", 1), ("b", 3), ("c", 8), ("d", 0), ("e", 0), ("f", 2)]
    filled = state.cursor_advance_backfill(config, NE, 4)
    assert rows(filled, *columns) == [("a", 4), ("b", 3 + 3), ("c", 12), ("d", 4), ("e", 0), ("f", 6)]
    beyond = state.cursor_advance_backfill(config.withColumn("effective_from_epoch", F.lit(NE + 5)), NE, 4)
    assert rows(beyond, *columns) == rows(config, *columns)


def test_active_failures(spark, overrides, rows):
    config = configs(
        spark,
        [("a", "ENGINE", True, 1, 8), ("b", "ENGINE", True, 1, 9), ("c", "ENGINE", True, 1, None), ("d", "ENGINE", False, 1, 1), ("e", "COOLANT", True, 1, 1)],
    )
    found = rows(series.active_failures(config, overrides), "entity_id", "max_epochs", "status")
    assert found == [("a", 8, "ACTIVE"), ("b", 8, "OFFLINE"), ("c", 8, "ACTIVE")]


def test_an_override_without_a_series_is_listed(spark, overrides, rows):
    config = configs(spark, [("a", "ENGINE", True, 1, 0), ("b", "ENGINE", True, 1, 2)])
    found = rows(series.active_failures(config, overrides.limit(0)), "entity_id", "max_epochs", "status")
    assert found == [("a", 0, "ACTIVE"), ("b", 0, "OFFLINE")]
