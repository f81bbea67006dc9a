import math
import random

import pytest
from pyspark.sql import functions as F

from convoy.functions.geo import haversine_miles, map_xy
from convoy.operators import fleet, routes
from convoy.operators.nearest import LEVELS, nearest
from convoy.settings import MILES_PER_EPOCH

EDGE = "edge_id bigint, from_node string, to_node string, road_geometry_sampled struct<type:string, coordinates:array<array<double>>>"
PATH = "entity_id string, sequence_num bigint, node_id string"


def edges(spark, data):
    return spark.createDataFrame([(i, f, t, ("LineString", line)) for i, f, t, line in data], EDGE)


def path(spark, *stops, entity="e", step=1):
    return spark.createDataFrame([(entity, i * step, n) for i, n in enumerate(stops)], PATH)


def line(spark, path_df, edge_df):
    hops = routes.path_hops(path_df, ["entity_id"])
    points = routes.line_points(routes.hop_points(hops, edge_df, ["entity_id"]), ["entity_id"])
    return [(r.pos, r.lon, r.lat) for r in points.orderBy("pos").collect()]


def test_edges_match_both_ways_round(spark):
    roads = edges(spark, [(1, "a", "b", [[0.0, 0.0], [1.0, 0.0]]), (2, "c", "b", [[2.0, 9.0], [1.0, 9.0]])])
    assert line(spark, path(spark, "a", "b", "c"), roads) == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 9.0), (3, 2.0, 9.0)]
    assert line(spark, path(spark, "c", "b", "a", step=1000), roads) == [(0, 2.0, 9.0), (1, 1.0, 9.0), (2, 1.0, 0.0), (3, 0.0, 0.0)]


def test_self_pairs_missing_edges_and_empty_lines(spark):
    roads = edges(spark, [(1, "a", "a", [[5.0, 5.0]]), (2, "a", "b", []), (3, "b", "c", [[1.0, 1.0]])])
    assert line(spark, path(spark, "a", "a", "b", "c", "x"), roads) == [(0, 5.0, 5.0), (1, 1.0, 1.0)]
    no_loop = edges(spark, [(3, "b", "c", [[1.0, 1.0]])])
    assert line(spark, path(spark, "b", "b", "c"), no_loop) == [(0, 1.0, 1.0)]


@pytest.mark.parametrize("seed", [3, 4])
def test_undirected_join_equals_the_or_join(spark, rows, seed):
    rnd = random.Random(seed)
    names = "abcd"
    roads = edges(spark, [(i, rnd.choice(names), rnd.choice(names), [[float(i), 0.0], [float(i), 1.0]]) for i in range(12)])
    walks = path(spark, *[rnd.choice(names) for _ in range(10)])
    hops = routes.path_hops(walks, ["entity_id"])
    h, e = hops.alias("h"), roads.alias("e")
    same = (F.col("e.from_node") == F.col("h.from_node")) & (F.col("e.to_node") == F.col("h.to_node"))
    turned = (F.col("e.from_node") == F.col("h.to_node")) & (F.col("e.to_node") == F.col("h.from_node"))
    plain = h.join(e, same | turned).select("h.sequence_num", "e.edge_id")
    quick = routes.hop_points(hops, roads, ["entity_id"]).filter("coord_idx = 0").select("sequence_num", "edge_id")
    assert rows(quick) == rows(plain)


def test_linestring_and_lengths(spark):
    roads = edges(spark, [(1, "a", "b", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])])
    hops = routes.path_hops(path(spark, "a", "b"), ["entity_id"])
    points = routes.line_points(routes.hop_points(hops, roads, ["entity_id"]), ["entity_id"])
    folded = routes.as_linestring(points, ["entity_id"]).first()
    assert folded.geometry.coordinates == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]] and folded.point_count == 3
    degree = 3959 * math.pi / 180
    assert routes.route_lengths(points).first().distance_miles == round(2 * degree, 1)
    one = spark.range(1).select(haversine_miles(F.lit(40.0), F.lit(-74.0), F.lit(34.0), F.lit(-118.0)).alias("d")).first().d
    law = math.sin(math.radians(40)) * math.sin(math.radians(34)) + math.cos(math.radians(40)) * math.cos(math.radians(34)) * math.cos(math.radians(44))
    assert one == pytest.approx(3959 * math.acos(law), rel=1e-9)


def test_downsample_keeps_the_last_point(spark, rows):
    points = spark.range(8).selectExpr("'e' AS entity_id", "id AS pos", "0D AS lon", "0D AS lat")
    assert rows(routes.polyline_downsample(points, 3), "pos") == [(0,), (3,), (6,), (7,)]
    assert rows(routes.polyline_downsample(points.filter("pos < 7"), 3), "pos") == [(0,), (3,), (6,)]


def test_split_shares_the_cut_point(spark, rows):
    points = spark.range(5).selectExpr("'e' AS entity_id", "id AS pos", "id - 100D AS lon", "40D AS lat")
    truck = spark.createDataFrame([("e", 40.3, -98.5)], "entity_id string, latitude double, longitude double")
    found = rows(routes.polyline_split(points, truck), "part", "pos")
    assert found == [("REMAINING", i) for i in (1, 2, 3, 4)] + [("TRAVELLED", 0), ("TRAVELLED", 1)]


def test_split_measures_on_the_map(spark, rows):
    # One degree of latitude is 24 pixels, one of longitude 16.4.
    points = spark.createDataFrame([("e", 0, -100.0, 41.0), ("e", 1, -101.2, 40.0)], "entity_id string, pos bigint, lon double, lat double")
    truck = spark.createDataFrame([("e", 40.0, -100.0)], "entity_id string, latitude double, longitude double")
    assert rows(routes.polyline_split(points, truck), "part", "pos") == [("REMAINING", 1), ("TRAVELLED", 0), ("TRAVELLED", 1)]
    outside = spark.range(1).select(*map_xy(F.lit(80.0), F.lit(0.0))).first()
    assert tuple(outside) == (950.0, 10.0)


@pytest.mark.parametrize("levels, keyed", [((0.5,), True), ((1.0, 1 / 16), False), ((30.0, 3.0, 0.25), True), ((30.0,), True), (LEVELS, False), (LEVELS, True)])
def test_nearest_equals_brute_force(spark, levels, keyed):
    rnd = random.Random(8)
    points = [(rnd.choice("kl"), i, round(rnd.uniform(25, 49), 2), round(rnd.uniform(-124, -67), 2)) for i in range(150)]
    points += [(k, 500 + i, lat, lon) for i, (k, _, lat, lon) in enumerate(points[:40])]  # shared places
    points += [("k", 900, None, -70.0)]
    wanted = [(rnd.choice("klm"), i, rnd.choice([rnd.uniform(25, 49), 0.0, 30.0]), rnd.uniform(-124, 10)) for i in range(60)]
    q = spark.createDataFrame(wanted, "key string, id int, lat double, lon double")
    p = spark.createDataFrame(points, "key string, item int, plat double, plon double")
    found = {r.id: r.item for r in nearest(q, p if keyed else p.drop("key"), ["key"] if keyed else [], ["item"], levels).collect()}
    expected = {}
    for key, i, lat, lon in wanted:
        own = [((lat - y) * (lat - y) + (lon - x) * (lon - x), item) for k, item, y, x in points if (k == key or not keyed) and y is not None]
        if own:
            expected[i] = min(own)[1]
    assert found == expected


def test_nearest_without_a_key_lists_no_cells_globally(spark, tmp_path):
    """Points in all quarters of the plane, queries far from any; no scalar, no one-task exchange."""
    rnd = random.Random(5)
    points = [(i, rnd.uniform(-89, 89), rnd.uniform(-179, 179)) for i in range(60)]
    wanted = [(i, rnd.uniform(-89, 89), rnd.uniform(-179, 179)) for i in range(80)] + [(80, 0.0, 0.0), (81, -16.0, 16.0)]
    spark.createDataFrame(points, "item int, plat double, plon double").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(wanted, "id int, lat double, lon double").write.parquet(f"{tmp_path}/q")
    found = nearest(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/p"), [], ["item"])
    expected = {i: min(((lat - y) ** 2 + (lon - x) ** 2, item) for item, y, x in points)[1] for i, lat, lon in wanted}
    assert {r.id: r.item for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Subquery" not in plan and "NestedLoop" not in plan


def waypoints(spark, marks, entity="e"):
    data = [(entity, i, float(i), float(-i), 350.0, float(m)) for i, m in enumerate(marks)]
    return spark.createDataFrame(data, "entity_id string, epoch bigint, latitude double, longitude double, heading double, miles_from_start double")


def position(spark, epoch, marks=(0, 50, 100), broken=None, hours=None):
    route = spark.createDataFrame([("e", "R", "S", "T")], "entity_id string, route_name string, start_city string, end_city string")
    markers = spark.createDataFrame([("e", b) for b in (broken or [])], "entity_id string, breakdown_epoch bigint")
    stored = spark.createDataFrame([("e", "ENGINE_FAILURE", hours)], "entity_id string, predicted_failure_type string, predicted_hours_to_failure double")
    return fleet.truck_positions(route, waypoints(spark, marks), markers, stored, epoch).first()


def test_positions_out_and_back(spark):
    per_leg = 100 / MILES_PER_EPOCH
    start = position(spark, 0)
    assert (start.trip_phase, start.latitude, start.heading, start.legs_completed, start.ttf_hours) == ("OUTBOUND", 0.0, 350.0, 0, None)
    assert position(spark, int(per_leg * 0.99)).trip_phase == "ARRIVING"
    turned = position(spark, int(per_leg * 1.01))
    assert (turned.trip_phase, turned.is_return_trip, turned.route_display, turned.heading, turned.latitude) == ("JUST_TURNED", True, "T > S", 170.0, 2.0)
    back = position(spark, int(per_leg * 1.5), hours=2.25)
    assert (back.trip_phase, back.latitude, back.start_city, back.end_city, back.ttf_hours) == ("RETURNING", 1.0, "T", "S", 2.3)
    assert position(spark, int(per_leg * 2.5), hours=-1.0).ttf_hours is None


def test_positions_do_not_depend_on_how_the_targets_travel(spark, rows):
    marks = waypoints(spark, (0, 30, 30, 60, 90)).unionByName(waypoints(spark, (0, 10), entity="f"))
    wanted = spark.createDataFrame([("e", 45.0), ("f", 9.0), ("g", 1.0)], "entity_id string, target_miles double")
    sent = rows(fleet.nearest_mile(marks, wanted))
    assert [(r[0], r[1]) for r in sent] == [("e", 1), ("f", 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(fleet.nearest_mile(marks, wanted)) == sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_mile_equals_brute_force(spark, seed):
    """Blocks with gaps between them, targets inside, between and beyond, repeated miles, null miles."""
    rnd = random.Random(seed)
    marks = {f"e{k}": [rnd.choice([rnd.uniform(0, 150), rnd.uniform(900, 1000), float(rnd.randrange(0, 2000, 50)), None]) for _ in range(60)] for k in range(8)}
    marks["lone"], marks["void"] = [730.0], [None, None]
    wanted = {e: rnd.choice([rnd.uniform(-50, 2500), float(rnd.randrange(0, 2000, 25)), 100.0]) for e in marks}
    data = [(e, i, float(i), float(-i), 350.0, m) for e, ms in marks.items() for i, m in enumerate(ms)]
    table = spark.createDataFrame(data, waypoints(spark, []).schema)
    targets = spark.createDataFrame(list(wanted.items()), "entity_id string, target_miles double")
    expected = {}
    for e, ms in marks.items():
        known = [(abs(m - wanted[e]), i) for i, m in enumerate(ms) if m is not None]
        if known:
            expected[e] = min(known)[1]
    assert {r.entity_id: r.epoch for r in fleet.nearest_mile(table, targets).collect()} == expected


def test_positions_read_waypoints_twice_and_join_them_once(spark, tmp_path):
    waypoints(spark, range(0, 1000, 10)).write.parquet(f"{tmp_path}/w")
    route = spark.createDataFrame([("e", "R", "S", "T")], "entity_id string, route_name string, start_city string, end_city string")
    stored = spark.createDataFrame([], "entity_id string, predicted_failure_type string, predicted_hours_to_failure double")
    markers = spark.createDataFrame([], "entity_id string, breakdown_epoch bigint")
    found = fleet.truck_positions(route, spark.read.parquet(f"{tmp_path}/w"), markers, stored, 5000)
    assert found.count() == 1
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 2 and "ReusedExchange" in plan
    assert "ReadSchema: struct<entity_id:string,miles_from_start:double>" in plan


def test_broken_truck_stays_at_its_first_breakdown(spark):
    there = int(25 / MILES_PER_EPOCH)
    found = position(spark, 10**6, broken=[there * 3, there, None])
    assert found.is_broken_down and found.miles_driven == 25 and found.legs_completed == 0
    # Two waypoints equally far: the lower epoch is shown.
    assert position(spark, 0, marks=(10, 10, 100)).latitude == 0.0


def test_snap_merges_repeated_nodes(spark, rows):
    nodes = spark.createDataFrame([("a", 0.9, -0.9), ("b", 2.0, -2.0)], "node_id string, latitude double, longitude double")
    found = routes.snap_nodes(path(spark, "a", "b", "a", "x"), nodes, waypoints(spark, (0, 50, 100)))
    assert rows(found) == [("e", "a", 0, 50.0), ("e", "b", 1, 100.0)]


def test_segments(spark):
    marks = waypoints(spark, range(0, 1200, 100))
    schema = "entity_id string, segment_id string, from_miles double, to_miles double, backwards boolean, truck_lon double, truck_lat double, end_lon double, end_lat double"
    wanted = [("e", "out", 399.5, 601.0, False, 1.0, 2.0, 3.0, 4.0), ("e", "back", 601.0, 399.5, True, 1.0, 2.0, 3.0, 4.0), ("e", "short", 10.0, 20.0, False, 1.0, 2.0, 3.0, 4.0)]
    found = {}
    for r in routes.route_segments(marks, spark.createDataFrame(wanted, schema)).orderBy("pos").collect():
        found.setdefault(r.segment_id, []).append((r.pos, r.lat))
    assert found["out"] == [(0, 2.0), (1, 4.0), (2, 5.0), (3, 6.0)]
    assert found["back"] == [(0, 2.0), (1, 6.0), (2, 5.0), (3, 4.0)]
    assert found["short"] == [(0, 2.0), (1, 4.0)]
