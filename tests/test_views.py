from datetime import datetime, timedelta

from convoy.operators.scoring import score_rules
from convoy.plans.views import route_views, telemetry_views

START = datetime(2024, 5, 1)


def test_views_answer_sql(spark):
    data = [("a", START + timedelta(seconds=25 * i), 90.0 + i % 2, 30.0, 12.0 + (i % 2) / 10) for i in range(36)]
    telemetry = spark.createDataFrame(data, "entity_id string, ts timestamp_ntz, engine_temp double, trans_oil_pressure double, battery_voltage double")
    telemetry_views(telemetry, score_rules)
    assert spark.sql("SELECT sum(POINT_COUNT) AS n FROM TELEMETRY_5MIN_AGG").first().n == 36
    assert spark.sql("SELECT count(*) AS n FROM FEATURE_ENGINEERING_VIEW_TEMPORAL").first().n == 3
    found = spark.sql("SELECT PREDICTED_FAILURE_TYPE, TTF_MODEL_USED FROM ENHANCED_PREDICTIVE_VIEW_HYBRID_TTF").collect()
    assert [tuple(r) for r in found] == [("ENGINE_FAILURE", "basic_11_features")]


def test_route_view(spark):
    walk = spark.createDataFrame([("e", 0, "a"), ("e", 1, "b")], "entity_id string, sequence_num bigint, node_id string")
    road = [(1, "b", "a", ("LineString", [[0.0, 0.0], [1.0, 1.0]]))]
    edges = spark.createDataFrame(road, "edge_id bigint, from_node string, to_node string, road_geometry_sampled struct<type:string, coordinates:array<array<double>>>")
    names = spark.createDataFrame([("e", "R", "S", "T")], "entity_id string, route_name string, start_city string, end_city string")
    route_views(walk, edges, names)
    found = spark.sql("SELECT GEOMETRY.coordinates AS c, POINT_COUNT FROM ROUTE_GEOMETRY_DETAILED").first()
    assert (found.c, found.POINT_COUNT) == ([[1.0, 1.0], [0.0, 0.0]], 2)
