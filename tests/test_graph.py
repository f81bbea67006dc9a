import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from convoy.operators import graph, stops
from convoy.settings import SAFETY_FACTOR, SPEED_MPH

ADJACENT = "from_node string, to_node string, miles double"


def search(spark, roads, sources):
    both = spark.createDataFrame(roads, ADJACENT)
    starts = spark.createDataFrame([(s,) for s in sources], "node_id string")
    return {(r.source, r.target): (r.distance_miles, r.path) for r in graph.shortest_paths(both, starts).collect()}


def dijkstra(roads, source):
    found, heap = {}, [(0.0, [source])]
    while heap:
        dist, path = heapq.heappop(heap)
        if path[-1] in found:
            continue
        found[path[-1]] = (dist, path)
        for f, t, miles in roads:
            if f == path[-1] and t not in found and miles is not None and miles >= 0:
                heapq.heappush(heap, (dist + miles, path + [t]))
    return found


def test_cycles_ties_parallel_edges_and_unreachable(spark):
    roads = [("a", "c", 1.0), ("a", "b", 1.0), ("b", "d", 1.0), ("c", "d", 1.0), ("d", "a", 1.0), ("a", "b", 9.0), ("a", "a", 0.0), ("x", "a", 1.0), ("a", "x", -1.0), ("a", "x", None)]
    found = search(spark, roads, ["a", "b"])
    assert found["a", "a"] == (0.0, ["a"])
    assert found["a", "d"] == (2.0, ["a", "b", "d"])
    assert found["b", "c"] == (3.0, ["b", "d", "a", "c"])
    assert ("a", "x") not in found
    assert graph.rejected_edges(spark.createDataFrame(roads, ADJACENT)).count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_dijkstra(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(12)]
    pairs = {tuple(sorted(rnd.sample(names, 2))) for _ in range(18)}
    roads = [(a, b, float(rnd.randint(1, 5))) for a, b in pairs]
    roads += [(b, a, m) for a, b, m in roads]
    found = search(spark, roads, names)
    for source in names:
        expected = dijkstra(roads, source)
        assert {t: d for (s, t), d in found.items() if s == source} == expected
    for a, b, c in itertools.product(names[:5], repeat=3):
        if (a, b) in found and (b, c) in found:
            assert found[a, c][0] <= found[a, b][0] + found[b, c][0]
        if (a, b) in found:
            assert found[a, b][0] == found[b, a][0]


def test_a_round_writes_its_frontier_only(spark, monkeypatch):
    """On a chain every round improves one label, and the log is merged by levels."""
    written = []
    write = graph._write

    def counted(df, label):
        path = write(df, label)
        written.append((label, spark.read.parquet(path).count()))
        return path

    monkeypatch.setattr(graph, "_write", counted)
    monkeypatch.setattr(graph, "MERGED", 3)
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 1.5) for i in range(11)]
    found = search(spark, chain + [("n00", "n05", 100.0)], ["n00"])
    assert found["n00", "n11"] == (16.5, [f"n{i:02d}" for i in range(12)]) and len(found) == 12
    # Node 5 is reached twice, so it and the nodes behind it are improved twice.
    assert sum(n for label, n in written if label == "frontier") == 12 + 7
    assert max(n for label, n in written if label == "reached") == 2
    assert sum(n for label, n in written if label == "labels") < 3 * 19


# One truck on the path p0..p4 at road miles 0,100,..,400; centers on and off it.
MILES = {f"p{i}": 100.0 * i for i in range(5)}
ROADS = [("p1", "off", 30.0), ("off", "p2", 40.0), ("p2", "far", 5000.0)]
CENTERS = [(1, "p3", "Ahead"), (2, "p0", "Behind"), (3, "off", "Off"), (4, "far", "Far"), (5, "p3", "Twin")]


def scene(spark, here, back=False, hours=None, roads=ROADS):
    snapped = spark.createDataFrame([("e", n, i, m) for i, (n, m) in enumerate(MILES.items())], "entity_id string, node_id string, sequence_num int, road_miles double")
    spot = spark.createDataFrame([("e", 0.0, 0.0, here, back)], "entity_id string, latitude double, longitude double, position_miles double, is_return_trip boolean")
    close = spark.createDataFrame([("e", "p1")], "entity_id string, node_id string")
    hop = [(f"p{i}", f"p{i + 1}", 100.0) for i in range(4)] + list(roads)
    adjacent = spark.createDataFrame(hop + [(b, a, m) for a, b, m in hop], ADJACENT)
    nodes = spark.createDataFrame([(n,) for n in [*MILES, "off", "far"]], "node_id string")
    centers = spark.createDataFrame([(i, name, "City", "ST", n, 1.0, 2.0) for i, n, name in CENTERS], "center_id bigint, name string, city string, state_code string, node_id string, latitude double, longitude double")
    paths = graph.shortest_paths(adjacent, nodes)
    detours = graph.detour_table(paths, centers)
    stored = spark.createDataFrame([("e", hours)], "entity_id string, predicted_hours_to_failure double")
    departures = stops.departure_nodes(snapped, spot, close)
    scored = stops.scored_stops(departures, detours, snapped, spot, paths, stored)
    ranking = stops.service_ranking(scored, centers)
    return departures, stops.reconnect_candidates(snapped, spot), ranking


def test_departure_nodes_swap_on_the_way_back(spark, rows):
    departures, ahead, _ = scene(spark, 150.0)
    assert rows(departures) == [("e", "p1", True, False, True), ("e", "p2", False, True, False)]
    assert [r.node_id for r in ahead.orderBy("position").collect()] == ["p2", "p3", "p4"]
    departures, ahead, _ = scene(spark, 150.0, back=True)
    assert rows(departures) == [("e", "p1", False, True, True), ("e", "p2", True, False, False)]
    assert [r.node_id for r in ahead.orderBy("position").collect()] == ["p1", "p0"]


def test_no_node_ahead_at_the_end(spark, rows):
    departures, ahead, _ = scene(spark, 400.0)
    assert rows(departures, "node_id", "is_ahead") == [("p1", False), ("p4", False)]
    assert ahead.isEmpty()


def test_ranking_scores(spark):
    _, _, ranking = scene(spark, 150.0)
    found = {r.name: r for r in ranking.collect()}
    assert [r.name for r in sorted(found.values(), key=lambda r: r["rank"])] == ["Ahead", "Twin", "Off", "Behind", "Far"]
    assert (found["Ahead"].distance_mi, found["Ahead"].detour_mi, found["Ahead"].via) == (150, 0.0, "ON_ROUTE_AHEAD")
    assert (found["Behind"].distance_mi, found["Behind"].detour_mi, found["Behind"].via) == (150, 300.0, "ON_ROUTE_BEHIND")
    # 50 back to p1 and 30 over, 40 on to p2: 120 driven for the 50 the route would take.
    off = found["Off"]
    assert (off.departure_node, off.distance_mi, off.detour_mi, off.reconnect_node, off.reconnect_path) == ("p1", 80, 70.0, "p2", "off>p2")
    assert not found["Far"].safe and found["Far"].drive_hrs == round(5050 / SPEED_MPH, 1)


def test_way_back_without_a_node_ahead_doubles_the_distance(spark):
    _, _, ranking = scene(spark, 400.0)
    off = {r.name: r for r in ranking.collect()}["Off"]
    assert off.reconnect_node is None and off.detour_mi == 2 * off.distance_mi


def test_reasons(spark):
    def advice(**kwargs):
        return stops.service_recommendation(scene(spark, **kwargs)[2]).first()

    best = advice(here=150.0)
    assert best.reasoning == "Ahead is on your route ahead — 150 mi (2.7 hrs), zero detour. Best option!"
    assert best.max_safe_miles == round(6 * SAFETY_FACTOR * SPEED_MPH)
    assert advice(here=400.0, hours=2.5).reasoning == "Ahead is on your route behind — 100 mi (1.8 hrs), 200.0 mi added backtrack."
    assert advice(here=150.0, hours=0.1).reasoning == "EMERGENCY: Closest is Off at 80 mi. TTF too short to reach any center safely!"
    off = advice(here=150.0, hours=2.0)
    assert off.reasoning == "Off is off-route — 80 mi (1.5 hrs), reconnects at p2. 70.0 mi total added."


def test_reconnect_geometry_falls_back(spark, rows):
    keys = "center_node string, reconnect_node string"
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("x", "y"), ("z", "z")], keys)
    stored = spark.createDataFrame(
        [("a", "b", 0, 1.0, 1.0), ("a", "b", 1, 2.0, 2.0), ("b", "a", 0, 9.0, 9.0), ("d", "c", 0, 3.0, 3.0), ("d", "c", 1, 4.0, 4.0)],
        "from_node_id string, to_node_id string, pos bigint, lon double, lat double",
    )
    paths = spark.createDataFrame([("x", "y", ["x", "m", "y"]), ("z", "z", ["z"])], "source string, target string, path array<string>")
    nodes = spark.createDataFrame([(n, float(i), float(-i)) for i, n in enumerate("xyz")], "node_id string, latitude double, longitude double")
    found = rows(stops.reconnect_geometry(pairs, paths, stored, nodes), "center_node", "kind", "pos", "lon")
    assert found == [
        ("a", "FORWARD", 0, 1.0), ("a", "FORWARD", 1, 2.0), ("c", "REVERSED", 0, 4.0), ("c", "REVERSED", 1, 3.0),
        ("x", "NODES", 0, 0.0), ("x", "NODES", 2, -1.0),
    ]


def test_detour_lookup_ignores_or_honours_the_way_back(spark, rows):
    marks = spark.createDataFrame([("e", i, float(i), 0.0, 0.0, 100.0 * i) for i in range(3)], "entity_id string, epoch bigint, latitude double, longitude double, heading double, miles_from_start double")
    route = spark.createDataFrame([("e",)], "entity_id string")
    walk = spark.createDataFrame([("e", 0, "s"), ("e", 1, "t")], "entity_id string, sequence_num bigint, node_id string")
    nodes = spark.createDataFrame([("s", 0.0, 0.0), ("t", 2.0, 0.0)], "node_id string, latitude double, longitude double")
    detours = spark.createDataFrame([("s", 1, "c", 5.0, 0.1, "s"), ("t", 1, "c", 6.0, 0.1, "t")], "from_node_id string, to_center_id bigint, to_center_node_id string, distance_miles double, duration_hours double, path_nodes string")
    epoch = int(390 / (55 * 5 / 3600))  # almost home again
    assert rows(stops.detour_lookup(marks, route, walk, nodes, detours, epoch), "from_node_id") == [("t",)]
    assert rows(stops.detour_lookup(marks, route, walk, nodes, detours, epoch, direction_aware=True), "from_node_id") == [("s",)]
    assert graph.detour_candidates(detours.withColumn("distance_miles", F.lit(-1.0)), spark.createDataFrame([(1, "n", "c", "s", 0.0, 0.0)], "center_id bigint, name string, city string, state_code string, latitude double, longitude double")).isEmpty()


@pytest.mark.parametrize("seed", [3, 4])
def test_ranking_looks_at_few_drives_and_misses_none(spark, seed, monkeypatch):
    """Many center nodes: the pruned ranking equals that of all drives, ties in distance included."""
    rnd = random.Random(seed)
    names = [f"c{i:03d}" for i in range(150)]
    roads = [(names[rnd.randrange(i)], names[i], float(rnd.choice([20, 40, 40, 90]))) for i in range(1, 150)]
    roads += [(b, a, m) for a, b, m in roads]
    adjacent = spark.createDataFrame(roads, ADJACENT)
    entities = {"e1": (0.05, False), "e2": (3.0, True), "e3": (None, False), "e4": (0.0, False)}
    path = {e: rnd.sample(names, 6) for e in entities}
    walk = [(e, n, i, 60.0 * i) for e, ns in path.items() for i, n in enumerate(ns)]
    snapped = spark.createDataFrame(walk, "entity_id string, node_id string, sequence_num int, road_miles double")
    spots = spark.createDataFrame([(e, 0.0, 0.0, 130.0, back) for e, (_, back) in entities.items()], "entity_id string, latitude double, longitude double, position_miles double, is_return_trip boolean")
    close = spark.createDataFrame([(e, ns[rnd.randrange(6)]) for e, ns in path.items()], "entity_id string, node_id string")
    centers = spark.createDataFrame([(i, f"n{i}", "City", "ST", n, 1.0, 2.0) for i, n in enumerate(names * 2)], "center_id bigint, name string, city string, state_code string, node_id string, latitude double, longitude double")
    departures = stops.departure_nodes(snapped, spots, close)
    paths = stops.staged(graph.shortest_paths(adjacent, centers.select("node_id")), "test-paths")
    detours = graph.detour_table(paths, centers)
    hours = spark.createDataFrame([(e, h) for e, (h, _) in entities.items()], "entity_id string, predicted_hours_to_failure double")
    rounds, looked = [], stops._nearby_drives

    def counted(*args):
        drives, bounds = looked(*args)
        rounds.append(drives.count())
        return drives, bounds

    monkeypatch.setattr(stops, "_nearby_drives", counted)
    monkeypatch.setattr(stops, "BAND_MILES", 30.0)

    def ranked(**options):
        scored = stops.scored_stops(departures, detours, snapped, spots, paths, hours, **options)
        return sorted(tuple(r) for r in stops.service_ranking(scored, centers).drop("reconnect_path").collect())

    pruned = ranked()
    pruned_rounds, rounds[:] = list(rounds), []
    assert pruned == ranked(options=200)
    assert pruned_rounds[0] < rounds[0] / 2
