from datetime import datetime

import pytest
from pyspark.sql import functions as F

from convoy.operators import fleet, scoring, state
from convoy.operators.features import BASIC_FEATURES, TEMPORAL_FEATURES
from convoy.schemas import CLOCK, FAILURE_CONFIG, MARKERS, PREDICTIONS
from convoy.settings import Clock

NOW = datetime(2024, 5, 1, 12)
LATER = datetime(2024, 5, 1, 13)


def predictions(spark, at, data):
    """(entity, class, hours[, minute]) as stored predictions."""
    full = [(d[0], at(10, d[3] if len(d) > 3 else 7), d[1], d[2], "m", 1.0, 2.0, 3.0, NOW) for d in data]
    return spark.createDataFrame(full, PREDICTIONS)


def feature_rows(spark, data):
    names = ["entity_id", *TEMPORAL_FEATURES]
    schema = "entity_id string, " + ", ".join(f"{n} double" for n in TEMPORAL_FEATURES)
    rows = [tuple([d["entity_id"]] + [d.get(n, 0.5) for n in names[1:]]) for d in data]
    return spark.createDataFrame(rows, schema).withColumn("prediction_timestamp", F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))


def test_rule_classes_and_clamps(spark):
    nan = float("nan")
    found = scoring.score_rules(
        feature_rows(
            spark,
            [
                {"entity_id": "a", "stddev_battery_voltage": 0.96, "cumulative_volatility": 100.0},
                {"entity_id": "b", "avg_engine_temp": 300.0},
                {"entity_id": "c", "avg_trans_oil_pressure": 61.0, "avg_engine_temp": 0.5},
                {"entity_id": "d"},
                {"entity_id": "e", "avg_engine_temp": nan},
                {"entity_id": "f", "avg_engine_temp": 300.0, "stddev_engine_temp": None},
                {"entity_id": "g", "stddev_battery_voltage": 0.96, "temp_acceleration": nan},
                {"entity_id": "h", "stddev_battery_voltage": 0.95},
            ],
        )
    ).orderBy("entity_id").collect()
    assert [(r.predicted_failure_type, r.predicted_hours_to_failure, r.ttf_model_used) for r in found] == [
        ("ELECTRICAL_FAILURE", 0.1, "temporal_16_features"),
        ("ENGINE_FAILURE", 24.0, "basic_11_features"),
        ("TRANSMISSION_FAILURE", 0.1, "basic_11_features"),
        ("NORMAL", None, "none"),
        ("NORMAL", None, "none"),
        ("NORMAL", None, "none"),
        ("ELECTRICAL_FAILURE", 0.0, "temporal_16_features"),
        ("NORMAL", None, "none"),
    ]
    assert len(BASIC_FEATURES) == 11 and len(TEMPORAL_FEATURES) == 16


def test_upsert_overwrites_adds_keeps_and_repeats(spark, at, rows):
    old = predictions(spark, at, [("a", "NORMAL", None), ("b", "NORMAL", None)])
    new = predictions(spark, at, [("b", "ENGINE_FAILURE", 3.0), ("c", "NORMAL", None)])
    once = state.prediction_upsert(old, new, LATER)
    expected = [("a", "NORMAL", None, NOW), ("b", "ENGINE_FAILURE", 3.0, LATER), ("c", "NORMAL", None, LATER)]
    columns = ["entity_id", "predicted_failure_type", "predicted_hours_to_failure", "last_updated"]
    assert rows(once, *columns) == expected
    assert rows(state.prediction_upsert(once, new, LATER), *columns) == expected


def test_upsert_writes_nulls_over_old_values(spark, at, rows):
    old = predictions(spark, at, [("a", "ENGINE_FAILURE", 3.0)])
    new = predictions(spark, at, [("a", "NORMAL", None)])
    assert rows(state.prediction_upsert(old, new, LATER), "predicted_hours_to_failure") == [(None,)]


def test_markers_follow_the_predictions(spark, at, rows):
    empty = state.reset_state(spark, MARKERS)
    first = state.marker_maintenance(empty, predictions(spark, at, [("a", "ENGINE_FAILURE", 0.5), ("b", "ENGINE_FAILURE", 0.6), ("n", "NORMAL", None)]), NOW, 40)
    columns = ["entity_id", "failure_type", "first_failure_time", "breakdown_epoch"]
    assert rows(first, *columns) == [("a", "ENGINE_FAILURE", at(10, 5), 40), ("b", "ENGINE_FAILURE", at(10, 5), None)]
    # a changes class: two markers; b recovers: gone. A breakdown once set stays.
    second = state.marker_maintenance(first, predictions(spark, at, [("a", "ELECTRICAL_FAILURE", 0.2, 20), ("b", "NORMAL", None)]), LATER, 50)
    assert rows(second, *columns) == [
        ("a", "ELECTRICAL_FAILURE", at(10, 20), 50),
        ("a", "ENGINE_FAILURE", at(10, 5), 40),
    ]
    assert rows(state.marker_maintenance(second, predictions(spark, at, [("a", "ELECTRICAL_FAILURE", 0.2, 20)]), LATER, 60), *columns) == rows(second, *columns)
    assert state.marker_maintenance(second, predictions(spark, at, [("a", "NORMAL", None)]), LATER, 60).isEmpty()


def test_breakdown_projection_touches_open_markers_only(spark, at, rows):
    markers = spark.createDataFrame([(e, NOW, "ENGINE_FAILURE", NOW, b) for e, b in [("a", None), ("b", 7), ("c", None), ("d", None)]], MARKERS)
    stored = predictions(spark, at, [("a", "ENGINE_FAILURE", 1.999), ("b", "ENGINE_FAILURE", 1.0), ("c", "ENGINE_FAILURE", 2.5), ("d", "NORMAL", 1.0)])
    found = state.breakdown_projection(markers, stored, 100, 2)
    assert rows(found, "entity_id", "breakdown_epoch") == [("a", 100 + int(1.999 * 720)), ("b", 7), ("c", None), ("d", None)]


def test_config_upsert_keeps_cursors(spark, rows):
    config = spark.createDataFrame([("a", "ENGINE", False, 3, 9), ("b", "ENGINE", True, 3, None), ("c", "ENGINE", True, 4, None)], FAILURE_CONFIG)
    turned_on = spark.createDataFrame([("a", "electrical"), ("b", "engine"), ("d", "engine")], "entity_id string, failure_type string")
    assert rows(state.config_upsert(config, turned_on, 50)) == [
        ("a", "ELECTRICAL", True, 51, 9), ("b", "ENGINE", True, 51, 0), ("c", "ENGINE", True, 4, None), ("d", "ENGINE", True, 51, 0),
    ]


def test_clock_reset_and_fill(spark, rows):
    clock = state.reset_clock(spark, "main", NOW)
    assert rows(clock, "stream_name", "start_ts", "next_epoch", "step_seconds") == [("main", NOW, 0, 5)]
    part = spark.createDataFrame([("main", None, 8, None, None), ("other", None, None, None, None)], CLOCK)
    filled = state.ensure_clock(part, "main", LATER)
    assert rows(filled, "stream_name", "start_ts", "next_epoch", "step_seconds") == [("main", LATER, 8, 5), ("other", None, None, None)]
    assert state.reset_state(spark, MARKERS).isEmpty()


def telemetry(spark, data):
    schema = "entity_id string, ts timestamp_ntz, engine_temp double, trans_oil_pressure double, battery_voltage double"
    return spark.createDataFrame([(e, ts, 1.0, 2.0, 3.0) for e, ts in data], schema)


def test_retention_keeps_the_bound_itself(spark, rows):
    bound = datetime(2024, 4, 29, 12)
    kept = state.retention_filter(telemetry(spark, [("a", NOW), ("a", bound), ("a", datetime(2024, 4, 29, 11, 59, 59))]))
    assert rows(kept, "ts") == [(bound,), (NOW,)]


def test_fleet_status(spark, at, rows):
    clock = Clock(at(0), 100)  # the last two steps start at 00:08:10
    data = [("on", at(0, 8, 20)), ("edge", at(0, 8, 10)), ("old", at(0, 8, 9)), ("new", at(0, 8, 21)), ("down", at(0, 8, 20))]
    markers = spark.createDataFrame([("down", NOW, t, NOW, b) for t, b in [("X", 100), ("Y", 90)]] + [("on", NOW, "X", NOW, 101)], MARKERS)
    entities = spark.createDataFrame([(e,) for e in ("on", "edge", "old", "new", "down", "none")], "entity_id string")
    found = rows(fleet.fleet_status(entities, telemetry(spark, data), markers, clock), "entity_id", "status", "ts")
    assert found == [
        ("down", "OFFLINE", at(0, 8, 20)),
        ("edge", "OFFLINE", at(0, 8, 10)),
        ("new", "ONLINE", at(0, 8, 21)),
        ("none", "OFFLINE", None),
        ("old", "OFFLINE", None),
        ("on", "ONLINE", at(0, 8, 20)),
    ]


@pytest.mark.parametrize(
    "made, age, colour",
    [((9, 55), 5, "green"), ((9, 54, 59), 6, "orange"), ((9, 1), 59, "orange"), ((9, 0), 60, "red"), ((10, 1), 0, "green")],
)
def test_freshness_colours(spark, at, made, age, colour):
    stored = predictions(spark, at, [("a", "NORMAL", None)]).withColumn("prediction_timestamp", F.lit(str(at(*made))).cast("timestamp_ntz"))
    found = fleet.prediction_freshness(stored, telemetry(spark, [("a", at(10))]), Clock(at(0), 0)).first()
    assert (found.age_minutes, found.age_color) == (age, colour)
    assert found.prediction_key == "a_2024-05-01 12:00:00.000"


def test_freshness_without_telemetry(spark, at):
    stored = predictions(spark, at, [("a", "NORMAL", None)])
    fresh = fleet.prediction_freshness(stored, telemetry(spark, []), Clock(at(0), 0))
    assert (fresh.first().age_minutes, fresh.first().age_color) == (0, "red")
    assert fleet.refresh_due(fresh).first().refresh_due is False


def test_chart_drops_partial_slices_only_in_the_raw_variant(spark, at, rows):
    data = telemetry(spark, [("a", at(0, 58)), ("a", at(1, 1)), ("a", at(2, 0, 30))])
    # Newest slice end 02:05, so the bound is 01:05 and whole slices ending there stay.
    assert rows(fleet.chart_data(data, 1), "timestamp") == [("2024-05-01 01:05:00",), ("2024-05-01 02:05:00",)]
    assert rows(fleet.chart_data_raw(data, 1), "timestamp") == [("2024-05-01 01:05:00",), ("2024-05-01 02:05:00",)]
    late = telemetry(spark, [("a", at(1, 0, 10)), ("a", at(1, 2)), ("a", at(2, 1))])
    raw = fleet.chart_data_raw(late.withColumn("engine_temp", F.minute("ts").cast("double")), 1).orderBy("timestamp").first()
    assert (raw.timestamp, raw.engine_temp) == ("2024-05-01 01:05:00", 2.0)


def test_chart_keeps_every_slice_unless_told_otherwise(spark, at):
    hours = spark.range(30_000).selectExpr(
        "concat('T', id % 1000) AS entity_id", "timestamp_ntz '2024-05-01 00:00:00' + make_dt_interval(0, id div 1000) AS ts",
        "1.0D AS engine_temp", "1.0D AS trans_oil_pressure", "1.0D AS battery_voltage")
    assert fleet.chart_data(hours, 48).count() == 30_000
    first = fleet.chart_data(hours, 48, limit=2).collect()
    assert [(r.timestamp, r.entity_id) for r in first] == [("2024-05-01 00:05:00", "T0"), ("2024-05-01 00:05:00", "T1")]


def test_newest_of_several_incoming_rows_counts(spark, at, rows):
    stored = predictions(spark, at, [("a", "NORMAL", None)])
    early = stored.withColumn("predicted_failure_type", F.lit("ENGINE_FAILURE"))
    late = early.withColumn("prediction_timestamp", F.col("prediction_timestamp") + F.expr("INTERVAL 1 HOUR")).withColumn("predicted_failure_type", F.lit("ELECTRICAL_FAILURE"))
    found = state.prediction_upsert(stored, early.unionByName(late).unionByName(early), NOW)
    assert rows(found, "entity_id", "predicted_failure_type") == [("a", "ELECTRICAL_FAILURE")]
    twice = spark.createDataFrame([("a", "engine"), ("a", "transmission")], "entity_id string, failure_type string")
    config = spark.createDataFrame([], "entity_id string, failure_type string, enabled boolean, effective_from_epoch long, failure_next_epoch long")
    assert rows(state.config_upsert(config, twice, 5), "entity_id", "failure_type") == [("a", "TRANSMISSION")]


def test_counters_and_listing(spark, at, rows):
    stored = predictions(spark, at, [("a", "ENGINE_FAILURE", 1.0), ("b", None, None), ("c", "NORMAL", None)])
    found = fleet.fleet_counters(telemetry(spark, [("a", NOW), ("a", LATER), ("b", NOW)]), stored)
    assert rows(found) == [(2, 1)]
    markers = spark.createDataFrame([("b", NOW, "X", NOW, 1), ("a", NOW, "X", NOW, 1)], MARKERS)
    assert [tuple(r) for r in fleet.marker_listing(markers).collect()] == [("a", "2024-05-01 12:00:00", "X"), ("b", "2024-05-01 12:00:00", "X")]
