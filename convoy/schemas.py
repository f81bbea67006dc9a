"""Column types of the fleet tables, as DDL text."""

from __future__ import annotations

_MEASURES = "engine_temp DOUBLE, trans_oil_pressure DOUBLE, battery_voltage DOUBLE"
_CURRENT = "current_engine_temp DOUBLE, current_trans_pressure DOUBLE, current_battery_voltage DOUBLE"
_LINE = "STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>"

TELEMETRY = f"ts TIMESTAMP_NTZ, entity_id STRING, {_MEASURES}, status STRING"
TRAINING = (
    f"ts TIMESTAMP_NTZ, entity_id STRING, failure_type STRING, time_to_failure DOUBLE, {_MEASURES}, failure_flag BIGINT"
)
BASELINE_SEED = f"entity_id STRING, epoch BIGINT, {_MEASURES}"
OVERRIDE_SEED = f"failure_type STRING, epoch BIGINT, {_MEASURES}"
CLOCK = (
    "stream_name STRING, start_ts TIMESTAMP_NTZ, next_epoch BIGINT, step_seconds BIGINT, last_updated TIMESTAMP_NTZ"
)
FAILURE_CONFIG = (
    "entity_id STRING, failure_type STRING, enabled BOOLEAN, effective_from_epoch BIGINT, failure_next_epoch BIGINT"
)
PREDICTIONS = (
    "entity_id STRING, prediction_timestamp TIMESTAMP_NTZ, predicted_failure_type STRING, "
    f"predicted_hours_to_failure DOUBLE, ttf_model_used STRING, {_CURRENT}, last_updated TIMESTAMP_NTZ"
)
MARKERS = (
    "entity_id STRING, first_failure_time TIMESTAMP_NTZ, failure_type STRING, last_updated TIMESTAMP_NTZ, breakdown_epoch BIGINT"
)
ROUTES = (
    "entity_id STRING, route_name STRING, start_city STRING, end_city STRING, current_city STRING, "
    "progress_percent DOUBLE, direction STRING, route_miles DOUBLE, origin_node STRING, destination_node STRING"
)
WAYPOINTS = (
    "entity_id STRING, epoch BIGINT, latitude DOUBLE, longitude DOUBLE, heading DOUBLE, "
    "miles_from_start DOUBLE, percent_complete DOUBLE"
)
SERVICE_CENTERS = (
    "center_id BIGINT, name STRING, city STRING, state_code STRING, latitude DOUBLE, longitude DOUBLE, "
    "capabilities ARRAY<STRING>, available_bays BIGINT, node_id STRING"
)
NODES = (
    "node_id STRING, name STRING, latitude DOUBLE, longitude DOUBLE, is_junction BOOLEAN, is_service_center BOOLEAN"
)
EDGES = (
    f"edge_id BIGINT, from_node STRING, to_node STRING, highway STRING, miles DOUBLE, road_geometry_sampled {_LINE}"
)
PATH_NODES = "entity_id STRING, sequence_num BIGINT, node_id STRING, cumulative_miles DOUBLE"
ADJACENCY = "from_node STRING, to_node STRING, miles DOUBLE"
DETOURS = (
    "from_node_id STRING, to_center_id BIGINT, to_center_node_id STRING, distance_miles DOUBLE, "
    f"duration_hours DOUBLE, path_nodes STRING, geometry {_LINE}"
)
