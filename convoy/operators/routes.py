"""Route lines as long tables of points, their length, thinning and cutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions.geo import haversine_miles, map_xy
from convoy.operators.blocks import number_rows, scan_blocks
from convoy.operators.nearest import nearest

BLOCK = 256

# Grid cells of nearest-point matching on the map, in pixels.
MAP_LEVELS = (20.0, 1.25)


def _undirected(frame: DataFrame) -> DataFrame:
    """Order-free end points; equality on them is 'a to b or b to a', self-loops included."""
    return frame.withColumns(
        {"_lo": F.least("from_node", "to_node"), "_hi": F.greatest("from_node", "to_node")}
    )


def path_hops(path: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive node pairs along each path of (keys, sequence_num, node_id)."""
    backwards = path.withColumns(
        {"_order": -F.col("sequence_num"), "_block": -F.floor(F.col("sequence_num") / BLOCK)}
    )
    ahead = scan_blocks(backwards, keys, "_block", ["_order"], values=["node_id"])
    return ahead.filter(F.col("_prev1.node_id").isNotNull()).select(
        *keys, "sequence_num", F.col("node_id").alias("from_node"), F.col("_prev1.node_id").alias("to_node")
    )


def hop_points(hops: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Geometry points of each hop in travel direction, edges matched either way round.

    The match is an equality on the ordered end points, not an OR of two equalities.
    """
    roads = _undirected(
        edges.select("edge_id", "from_node", "to_node", F.col("road_geometry_sampled.coordinates").alias("_line"))
    ).withColumnRenamed("from_node", "_edge_from")
    oriented = _undirected(hops).join(roads.drop("to_node"), ["_lo", "_hi"]).withColumn(
        "_line", F.when(F.col("_edge_from") == F.col("from_node"), F.col("_line")).otherwise(F.reverse("_line"))
    )
    return oriented.select(*keys, "sequence_num", "edge_id", F.posexplode("_line").alias("coord_idx", "_point")).select(
        *keys, "sequence_num", "edge_id", "coord_idx", F.col("_point")[0].alias("lon"), F.col("_point")[1].alias("lat")
    )


def line_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Add the 0-based position ``pos`` along each line."""
    blocked = points.withColumn("_block", F.floor(F.col("sequence_num") / BLOCK))
    numbered = number_rows(blocked, keys, "_block", ["sequence_num", "coord_idx", "edge_id"], "_n")
    return numbered.select(*keys, (F.col("_n") - 1).alias("pos"), "lon", "lat")


def route_geometry(path_nodes: DataFrame, edges: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per point of each entity's route, with the route's names and point count."""
    points = line_points(hop_points(path_hops(path_nodes, ["entity_id"]), edges, ["entity_id"]), ["entity_id"])
    sizes = points.groupBy("entity_id").agg(F.count(F.lit(1)).alias("point_count"))
    named = routes.select("entity_id", "route_name", "start_city", "end_city").join(sizes, "entity_id")
    return points.join(named, "entity_id")


def as_linestring(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points folded to one GeoJSON-shaped row per line, for export of single routes.

    The points of every block of ``BLOCK`` positions come together first, on many tasks, then the
    blocks of a line: what meets in one task is sorted blocks of bare coordinates. A line becomes
    one array, as that format asks; what outgrows a row stays with the long table.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lon", "lat")))
    part = F.transform(ordered, lambda p: F.array(p["lon"], p["lat"])).alias("_part")
    parts = points.groupBy(*keys, F.floor(F.col("pos") / BLOCK).alias("_block")).agg(part)
    line = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_part"))), lambda b: b["_part"]))
    return parts.groupBy(*keys).agg(line.alias("_line"), F.sum(F.size("_part")).alias("point_count")).select(
        *keys,
        F.struct(F.lit("LineString").alias("type"), F.col("_line").alias("coordinates")).alias("geometry"),
        "point_count",
    )


def route_lengths(points: DataFrame) -> DataFrame:
    """Great-circle length of each route in miles, rounded half to even at one digit."""
    blocked = points.select("entity_id", "pos", "lon", "lat").withColumn("_block", F.floor(F.col("pos") / BLOCK))
    paired = scan_blocks(blocked, ["entity_id"], "_block", ["pos"], values=["lon", "lat"])
    leg = haversine_miles(F.col("_prev1.lat"), F.col("_prev1.lon"), F.col("lat"), F.col("lon"))
    return paired.groupBy("entity_id").agg(
        F.bround(F.coalesce(F.sum(leg), F.lit(0.0)), 1).alias("distance_miles"),
        F.count(F.lit(1)).alias("point_count"),
    )


def route_lines(points: DataFrame, routes: DataFrame) -> DataFrame:
    """One GeoJSON-shaped row per route with its name, length in miles and point count."""
    named = routes.select("entity_id", "route_name")
    lengths = route_lengths(points).drop("point_count")
    return as_linestring(points, ["entity_id"]).join(lengths, "entity_id").join(named, "entity_id")


def polyline_downsample(points: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th point of each line and its last one."""
    last = points.groupBy("entity_id").agg(F.max("pos").alias("_last"))
    return (
        points.join(last, "entity_id")
        .filter((F.col("pos") % every == 0) | (F.col("pos") == F.col("_last")))
        .drop("_last")
    )


def polyline_split(points: DataFrame, trucks: DataFrame) -> DataFrame:
    """Each line cut at the point nearest to its truck on the map, which belongs to both parts.

    ``trucks`` has (entity_id, latitude, longitude); ties go to the first point.
    """
    x, y = map_xy(F.col("latitude"), F.col("longitude"))
    queries = trucks.select("entity_id", y.alias("lat"), x.alias("lon"))
    x, y = map_xy(F.col("lat"), F.col("lon"))
    candidates = points.select("entity_id", "pos", y.alias("plat"), x.alias("plon"))
    cut = nearest(queries, candidates, ["entity_id"], ["pos"], MAP_LEVELS).select("entity_id", F.col("pos").alias("_cut"))
    part = F.when(F.col("pos") < F.col("_cut"), F.array(F.lit("TRAVELLED"))).when(
        F.col("pos") > F.col("_cut"), F.array(F.lit("REMAINING"))
    ).otherwise(F.array(F.lit("TRAVELLED"), F.lit("REMAINING")))
    return points.join(cut, "entity_id").select("entity_id", F.explode(part).alias("part"), "pos", "lon", "lat")


def route_segments(waypoints: DataFrame, segments: DataFrame, bucket_miles: float = 500.0) -> DataFrame:
    """Waypoints between two mile marks (one mile of slack), the truck's own position first.

    ``segments``: entity_id, segment_id, from_miles, to_miles, backwards, truck_lon,
    truck_lat, end_lon, end_lat. A segment reaches only the mile buckets it spans. One with
    at most one waypoint becomes the straight line from the truck to its end.
    """
    keys = ["entity_id", "segment_id"]
    low = F.least("from_miles", "to_miles") - 1
    high = F.greatest("from_miles", "to_miles") + 1
    spanned = segments.withColumns({"_low": low, "_high": high}).select(
        *keys,
        "_low",
        "_high",
        "backwards",
        F.explode(F.sequence(F.floor(F.col("_low") / bucket_miles), F.floor(F.col("_high") / bucket_miles))).alias("_bucket"),
    )
    marks = waypoints.select(
        "entity_id",
        "epoch",
        F.col("miles_from_start").alias("_miles"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        F.floor(F.col("miles_from_start") / bucket_miles).alias("_bucket"),
    )
    direction = F.when(F.col("backwards"), -1).otherwise(1)
    inside = (
        spanned.join(marks, ["entity_id", "_bucket"])
        .filter(F.col("_miles").between(F.col("_low"), F.col("_high")))
        .select(
            *keys,
            "lon",
            "lat",
            (F.col("_bucket") * direction).alias("_block"),
            (F.col("_miles") * direction).alias("_order"),
            (F.col("epoch") * direction).alias("_tie"),
        )
    )
    numbered = number_rows(inside, keys, "_block", ["_order", "_tie"], "pos")
    sizes = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    measured = segments.join(sizes, keys, "left")
    lines = numbered.join(sizes.filter(F.col("_n") > 1), keys).select(*keys, "pos", "lon", "lat")
    start = measured.select(*keys, F.lit(0).cast("long").alias("pos"), F.col("truck_lon").alias("lon"), F.col("truck_lat").alias("lat"))
    straight = measured.filter(F.col("_n").isNull() | (F.col("_n") <= 1)).select(
        *keys, F.lit(1).cast("long").alias("pos"), F.col("end_lon").alias("lon"), F.col("end_lat").alias("lat")
    )
    return lines.unionByName(start).unionByName(straight)


def snap_nodes(path_nodes: DataFrame, nodes: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Road miles of each path node: those of the entity's nearest waypoint.

    A node a path visits twice is one node here, with its first sequence number.
    """
    visited = path_nodes.groupBy("entity_id", "node_id").agg(F.min("sequence_num").alias("sequence_num"))
    queries = visited.join(
        nodes.select("node_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), "node_id"
    ).select("entity_id", "node_id", "sequence_num", "lat", "lon")
    marks = waypoints.select(
        "entity_id",
        F.col("miles_from_start").alias("road_miles"),
        F.col("latitude").alias("plat"),
        F.col("longitude").alias("plon"),
    )
    return nearest(queries, marks, ["entity_id"], ["road_miles"]).select(
        "entity_id", "node_id", "sequence_num", "road_miles"
    )


def nearest_center(trucks: DataFrame, centers: DataFrame) -> DataFrame:
    """The service center nearest to each truck."""
    queries = trucks.select("entity_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    places = centers.select("center_id", "name", F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    return nearest(queries, places, [], ["center_id", "name"]).select(
        "entity_id", "center_id", F.col("name").alias("center_name"), "distance_sq"
    )


def service_centers(centers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Map listing of the centers, with the coordinates of the node each one sits on."""
    placed = nodes.select("node_id", F.array("longitude", "latitude").alias("node_coord"))
    return centers.join(placed, "node_id", "left").select(
        "center_id",
        F.col("name").alias("center_name"),
        "city",
        F.col("state_code").alias("state"),
        "latitude",
        "longitude",
        "node_id",
        "node_coord",
    )
