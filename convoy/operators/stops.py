"""Where a failing truck should stop: departure nodes, reconnection, ranking.

One job covers all trucks. Inputs shared below: ``snapped`` (entity_id, node_id, road_miles)
from ``snap_nodes``; ``positions`` (entity_id, position_miles, is_return_trip, latitude,
longitude) from ``stop_positions``; ``paths`` from ``shortest_paths``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convoy.operators.fleet import leg_position, nearest_mile, route_extent
from convoy.operators.nearest import nearest
from convoy.settings import DEFAULT_TTF_HOURS, MILES_PER_EPOCH, SAFETY_FACTOR, SPEED_MPH, staged

# Report sizes, score steps and the wording of the advice.
RECONNECT_NODES = 5
OPTION_ROWS = 10
SAFE_SCORE, UNSAFE_SCORE = 10000, 20000
AHEAD_TEXT = "%s is on your route ahead — %d mi (%.1f hrs), zero detour. Best option!"
BEHIND_TEXT = "%s is on your route behind — %d mi (%.1f hrs), %s mi added backtrack."
RECONNECT_TEXT = "%s is off-route — %d mi (%.1f hrs), reconnects at %s. %s mi total added."
NEARBY_TEXT = "%s is %d mi away (%.1f hrs). Reachable safely. %s mi detour."
EMERGENCY_TEXT = "EMERGENCY: Closest is %s at %d mi. TTF too short to reach any center safely!"

#: Width of the bands by which center nodes are found within a range.
BAND_MILES = 100.0


def nearest_path_node(trucks: DataFrame, path_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of its own path nearest to each truck, on the plane in degrees."""
    queries = trucks.select("entity_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    places = (
        path_nodes.select("entity_id", "node_id")
        .distinct()
        .join(nodes.select("node_id", F.col("latitude").alias("plat"), F.col("longitude").alias("plon")), "node_id")
    )
    return nearest(queries, places, ["entity_id"], ["node_id"]).select("entity_id", "node_id", "distance_sq")


def stop_positions(
    trucks: DataFrame, waypoints: DataFrame, nearest_nodes: DataFrame, snapped: DataFrame, epoch: int
) -> DataFrame:
    """Road miles and travel direction of each truck; before the start, those of its nearest node.

    The position follows the clock alone: a breakdown does not freeze it here.
    """
    at_node = nearest_nodes.join(snapped, ["entity_id", "node_id"]).select("entity_id", F.col("road_miles").alias("_node_miles"))
    legs = leg_position(route_extent(waypoints), None, epoch)
    moving = (F.col("route_miles") > 0) & F.lit(epoch > 0)
    return (
        trucks.select("entity_id", "latitude", "longitude")
        .join(legs.select("entity_id", "route_miles", "is_return_trip", "target_miles"), "entity_id", "left")
        .join(at_node, "entity_id", "left")
        .select(
            "entity_id",
            "latitude",
            "longitude",
            F.when(moving, F.col("target_miles")).otherwise(F.coalesce("_node_miles", F.lit(0.0))).alias("position_miles"),
            F.when(moving, F.col("is_return_trip")).otherwise(False).alias("is_return_trip"),
        )
    )


def departure_nodes(snapped: DataFrame, positions: DataFrame, nearest_nodes: DataFrame) -> DataFrame:
    """Nodes a truck may leave its route at: the one behind, the one ahead, the nearest."""
    miles, here = F.col("road_miles"), F.col("position_miles")
    spot = F.struct(miles, "node_id")
    bracket = (
        snapped.join(positions.select("entity_id", "position_miles", "is_return_trip"), "entity_id")
        .groupBy("entity_id", "is_return_trip")
        .agg(F.max(F.when(miles <= here, spot)).alias("_low"), F.min(F.when(miles > here, spot)).alias("_high"))
    )
    back = F.col("is_return_trip")
    sided = bracket.select(
        "entity_id",
        F.explode(
            F.array(
                F.struct(F.when(back, "AHEAD").otherwise("BEHIND").alias("role"), F.col("_low.node_id").alias("node_id")),
                F.struct(F.when(back, "BEHIND").otherwise("AHEAD").alias("role"), F.col("_high.node_id").alias("node_id")),
            )
        ).alias("_s"),
    ).select("entity_id", "_s.node_id", "_s.role").filter(F.col("node_id").isNotNull())
    closest = nearest_nodes.select("entity_id", "node_id", F.lit("NEAREST").alias("role"))
    role = F.col("role")
    return sided.unionByName(closest).groupBy("entity_id", "node_id").agg(
        *[F.max(role == r).alias(f"is_{r.lower()}") for r in ("BEHIND", "AHEAD", "NEAREST")]
    )


def reconnect_candidates(snapped: DataFrame, positions: DataFrame) -> DataFrame:
    """The five path nodes closest ahead of each truck in travel direction."""
    miles, here = F.col("road_miles"), F.col("position_miles")
    ahead = F.when(F.col("is_return_trip"), miles < here).otherwise(miles > here)
    order = W.partitionBy("entity_id").orderBy("route_miles_ahead", "node_id")
    return (
        snapped.join(positions.select("entity_id", "position_miles", "is_return_trip"), "entity_id")
        .filter(ahead)
        .select("entity_id", "node_id", "road_miles", F.abs(miles - here).alias("route_miles_ahead"))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= RECONNECT_NODES)
    )


def reconnect_best(approaches: DataFrame, candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """Cheapest way back to the route after an off-route stop.

    ``approaches``: entity_id, from_node_id, center_node, miles_to_center. Added miles are
    those driven beyond the route stretch skipped; ties go to the nearer node.
    """
    back = paths.select(
        F.col("source").alias("center_node"),
        F.col("target").alias("node_id"),
        F.col("distance_miles").alias("_back"),
        "path",
    )
    added = F.greatest(F.lit(0.0), F.col("miles_to_center") + F.col("_back") - F.col("route_miles_ahead"))
    choice = F.struct(added.alias("added"), F.col("_back").alias("dist"), F.col("node_id").alias("node"), "path")
    keys = ["entity_id", "from_node_id", "center_node", "miles_to_center"]
    return (
        approaches.join(candidates.select("entity_id", "node_id", "route_miles_ahead"), "entity_id")
        .join(back, ["center_node", "node_id"])
        .groupBy(*keys)
        .agg(F.min(choice).alias("_c"))
        .select(
            *keys,
            F.col("_c.node").alias("reconnect_node"),
            F.col("_c.dist").alias("reconnect_dist"),
            F.col("_c.added").alias("added_miles"),
            F.col("_c.path").alias("reconnect_path"),
        )
    )


def off_route_approaches(
    departures: DataFrame, detours: DataFrame, snapped: DataFrame, positions: DataFrame
) -> DataFrame:
    """Distinct drives from a truck over a departure node to an off-route center node."""
    return (
        _approaches(departures, _node_detours(detours), snapped, positions)
        .filter(F.col("center_miles").isNull())
        .select("entity_id", "from_node_id", "center_node", "miles_to_center")
    )


def _node_detours(detours: DataFrame) -> DataFrame:
    """Detours per node pair: centers sharing a node share the drive."""
    return (
        detours.filter(F.col("distance_miles") >= 0)
        .groupBy("from_node_id", F.col("to_center_node_id").alias("center_node"))
        .agg(F.min("distance_miles").alias("detour_miles"))
    )


def _approaches(departures: DataFrame, node_detours: DataFrame, snapped: DataFrame, positions: DataFrame) -> DataFrame:
    """Per truck, departure node and center node: the position, whether the center node lies
    on the path (``center_miles`` is set), and the miles to it over the departure node."""
    here = F.col("position_miles")
    leaving = (
        departures.select("entity_id", "node_id")
        .join(snapped.select("entity_id", "node_id", "road_miles"), ["entity_id", "node_id"], "left")
        .join(positions.select("entity_id", "position_miles", "is_return_trip"), "entity_id")
        .select(
            "entity_id",
            F.col("node_id").alias("from_node_id"),
            "position_miles",
            "is_return_trip",
            F.abs(here - F.coalesce("road_miles", here)).alias("_to_departure"),
        )
    )
    on_path = snapped.select(
        "entity_id", F.col("node_id").alias("center_node"), F.col("road_miles").alias("center_miles")
    )
    return (
        leaving.join(node_detours, "from_node_id")
        .join(on_path, ["entity_id", "center_node"], "left")
        .withColumn("miles_to_center", F.col("_to_departure") + F.col("detour_miles"))
        .drop("_to_departure", "detour_miles")
    )


def _ladder(node_detours: DataFrame) -> DataFrame:
    """The center nodes of each departure node by distance: place, band of miles, block of places."""
    by_miles = W.partitionBy("from_node_id").orderBy("detour_miles", "center_node")
    place = F.row_number().over(by_miles).cast("long")
    return node_detours.select(
        "from_node_id", "center_node", "detour_miles", place.alias("place"), F.floor(F.col("detour_miles") / BAND_MILES).alias("band")
    ).withColumn("block", F.floor((F.col("place") - 1) / OPTION_ROWS))


def _nearby_drives(leaving: DataFrame, ladder: DataFrame, furthest: float, more: int) -> tuple[DataFrame, DataFrame]:
    """Drives that may matter to a truck, and how far each departure has been looked at.

    For each departure the center nodes within the safe range, by bands of miles, and at least
    ``more`` places beyond. Both are joins on equal keys that meet only rows they return.
    """
    keys = ["entity_id", "from_node_id"]
    reach = F.least(F.col("safe_miles") - F.col("to_departure"), F.lit(furthest))
    banded = leaving.withColumn("_reach", reach).filter(F.col("_reach") >= 0)
    banded = banded.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_reach") / BAND_MILES))))
    within = staged(banded.join(ladder, ["from_node_id", "band"]).select(*leaving.columns, "center_node", "detour_miles", "place"), "within")
    # The bands hold the first places of a departure without a gap.
    ends = within.groupBy(*keys).agg(F.max("place").alias("_within"))
    further = leaving.join(ends, keys, "left").withColumn("_within", F.coalesce("_within", F.lit(0)))
    blocks = F.sequence(F.floor(F.col("_within") / OPTION_ROWS), F.floor((F.col("_within") + more - 1) / OPTION_ROWS))
    beyond = further.withColumn("block", F.explode(blocks)).join(ladder, ["from_node_id", "block"]).filter(F.col("place") > F.col("_within"))
    drives = staged(within.unionByName(beyond.select(*within.columns)), "drives")
    sizes = ladder.groupBy("from_node_id").agg(F.count(F.lit(1)).alias("_all"))
    seen = drives.groupBy(*keys, "to_departure").agg(F.max("place").alias("_seen"), F.max("detour_miles").alias("_miles"))
    left = seen.join(sizes, "from_node_id").filter(F.col("_seen") < F.col("_all"))
    # What has not been looked at is out of the safe range and no nearer than this.
    bounds = left.groupBy("entity_id").agg(F.min(UNSAFE_SCORE + F.col("to_departure") + F.col("_miles")).alias("bound"))
    return drives, bounds


def scored_stops(
    departures: DataFrame,
    detours: DataFrame,
    snapped: DataFrame,
    positions: DataFrame,
    paths: DataFrame,
    predictions: DataFrame,
    options: int = OPTION_ROWS,
) -> DataFrame:
    """Best approach per truck and center node, with distance, detour and score, for all center
    nodes that can be among a truck's ``options`` best.

    Everything a score depends on is a matter of nodes, so scoring runs on node pairs;
    centers join only afterwards. A truck meets the center nodes on its path, those within its
    safe range, and beyond it the nearest ones, which score by their distance: once its last
    option scores better than any drive not looked at could, it is done (an equal score is
    looked at). Other trucks look further in the next round.
    """
    leaving = staged(_leaving(departures, snapped, positions, predictions), "leaving")
    node_detours = staged(_node_detours(detours), "node-detours")
    ladder = staged(_ladder(node_detours), "ladder")
    furthest = ladder.agg(F.max("detour_miles")).first()[0] or 0.0
    on_path = snapped.select("entity_id", F.col("node_id").alias("center_node"), F.col("road_miles").alias("center_miles"))
    on_route = leaving.join(on_path, "entity_id").join(node_detours, ["from_node_id", "center_node"])
    candidates = staged(reconnect_candidates(snapped, positions), "candidates")

    done, more = None, options
    while True:
        drives, bounds = _nearby_drives(leaving, ladder, furthest, more)
        aside = drives.drop("place").join(on_path, ["entity_id", "center_node"], "left_anti").withColumn("center_miles", F.lit(None).cast("double"))
        scored = staged(_best_approaches(aside.unionByName(on_route), candidates, paths), "scored")
        nth = F.row_number().over(W.partitionBy("entity_id").orderBy("score"))
        last = scored.select("entity_id", "score", nth.alias("_nth")).filter(F.col("_nth") <= options)
        last = last.filter(F.col("_nth") == options).select("entity_id", F.col("score").alias("_last"))
        short = F.col("_last").isNull() | (F.col("_last") >= F.col("bound"))
        again = staged(bounds.join(last, "entity_id", "left").filter(short).select("entity_id"), "again")
        settled = scored.join(again, "entity_id", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if again.isEmpty():
            return done
        leaving = leaving.join(again, "entity_id", "left_semi")
        on_route = on_route.join(again, "entity_id", "left_semi")
        more *= 4


def _leaving(departures: DataFrame, snapped: DataFrame, positions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per truck and departure node: where it is, the miles to the node, and how far it can go safely."""
    here = F.col("position_miles")
    hours = predictions.select("entity_id", F.col("predicted_hours_to_failure").alias("_hours"))
    return (
        departures.select("entity_id", F.col("node_id").alias("from_node_id"))
        .join(snapped.select("entity_id", F.col("node_id").alias("from_node_id"), "road_miles"), ["entity_id", "from_node_id"], "left")
        .join(positions.select("entity_id", "position_miles", "is_return_trip"), "entity_id")
        .join(hours, "entity_id", "left")
        .withColumn("ttf_hours", F.coalesce("_hours", F.lit(DEFAULT_TTF_HOURS)))
        .select(
            "entity_id",
            "from_node_id",
            "position_miles",
            "is_return_trip",
            "ttf_hours",
            F.abs(here - F.coalesce("road_miles", here)).alias("to_departure"),
            (F.col("ttf_hours") * SAFETY_FACTOR * SPEED_MPH).alias("safe_miles"),
        )
    )


def _best_approaches(drives: DataFrame, candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """The best of a truck's drives to each center node, priced with the way back to the route."""
    drives = drives.withColumn("miles_to_center", F.col("to_departure") + F.col("detour_miles")).drop("detour_miles")
    off_route = drives.filter(F.col("center_miles").isNull()).select(
        "entity_id", "from_node_id", "center_node", "miles_to_center"
    )
    back = reconnect_best(off_route, candidates, paths).drop("miles_to_center")
    here, there = F.col("position_miles"), F.col("center_miles")
    on_route = F.col("on_route")
    distance, added = F.col("effective_dist"), F.col("added_miles")
    priced = (
        drives.join(back, ["entity_id", "from_node_id", "center_node"], "left")
        .withColumn("on_route", there.isNotNull())
        .withColumn(
            "ahead",
            on_route & F.when(F.col("is_return_trip"), there < here).otherwise(there > here),
        )
        .withColumn("effective_dist", F.when(on_route, F.abs(there - here)).otherwise(F.col("miles_to_center")))
        .withColumn(
            "detour_miles",
            F.when(F.col("ahead"), 0.0).otherwise(F.coalesce(F.when(~on_route, added), distance * 2)),
        )
        .withColumn("safe", distance <= F.col("safe_miles"))
        .withColumn(
            "score",
            F.when(F.col("ahead") & F.col("safe"), distance)
            .when(F.col("safe"), SAFE_SCORE + F.col("detour_miles"))
            .otherwise(UNSAFE_SCORE + distance),
        )
    )
    facts = [
        "effective_dist",
        "detour_miles",
        "on_route",
        "ahead",
        "safe",
        "reconnect_node",
        "reconnect_dist",
        "reconnect_path",
        "ttf_hours",
        "position_miles",
    ]
    best = F.min(F.struct("score", "effective_dist", "from_node_id", F.struct(*facts).alias("facts"))).alias("_b")
    return (
        priced.groupBy("entity_id", "center_node")
        .agg(best)
        .select(
            "entity_id",
            "center_node",
            F.col("_b.score").alias("score"),
            F.col("_b.from_node_id").alias("departure_node"),
            "_b.facts.*",
        )
    )


def service_ranking(scored: DataFrame, centers: DataFrame) -> DataFrame:
    """The ten best centers per truck, with the figures shown to a dispatcher.

    Centers of one node score alike and rank by their id, so only the first ten of each node
    can be among a truck's ten; the others never meet the trucks. Rank limits drop surplus
    rows before they move.
    """
    order = W.partitionBy("entity_id").orderBy("score", "center_id")
    by_id = W.partitionBy("center_node").orderBy("center_id")
    hours = F.col("effective_dist") / SPEED_MPH
    kind = (
        F.when(F.col("ahead"), "ON_ROUTE_AHEAD").when(F.col("on_route"), "ON_ROUTE_BEHIND").otherwise("DETOUR")
    )
    facts = centers.select("center_id", "name", "city", F.col("state_code").alias("state"), F.col("node_id").alias("center_node"))
    first = facts.withColumn("_nth", F.row_number().over(by_id)).filter(F.col("_nth") <= OPTION_ROWS).drop("_nth")
    return (
        scored.join(first, "center_node")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= OPTION_ROWS)
        .select(
            "entity_id",
            "rank",
            "center_id",
            "name",
            "city",
            "state",
            F.col("center_node").alias("node_id"),
            "departure_node",
            F.bround("effective_dist", 0).cast("long").alias("distance_mi"),
            F.bround(hours, 1).alias("drive_hrs"),
            F.bround("detour_miles", 1).alias("detour_mi"),
            "detour_miles",
            "on_route",
            "ahead",
            "safe",
            "reconnect_node",
            F.bround(F.coalesce("reconnect_dist", F.lit(0.0)), 1).alias("reconnect_dist"),
            F.array_join("reconnect_path", ">").alias("reconnect_path"),
            kind.alias("via"),
            "ttf_hours",
            "position_miles",
        )
    )


def service_recommendation(ranking: DataFrame) -> DataFrame:
    """The first choice per truck with its reason in words."""
    name, miles, hours = F.col("name"), F.col("distance_mi"), F.col("drive_hrs")
    # Miles print with one decimal; only added miles floored at nothing are a bare 0.
    backtrack = F.format_string("%.1f", F.col("detour_mi"))
    added = F.when(F.col("detour_miles") == 0, "0").otherwise(backtrack)
    reasoning = (
        F.when(F.col("safe") & F.col("ahead"), F.format_string(AHEAD_TEXT, name, miles, hours))
        .when(F.col("safe") & F.col("on_route"), F.format_string(BEHIND_TEXT, name, miles, hours, backtrack))
        .when(
            F.col("safe") & F.col("reconnect_node").isNotNull(),
            F.format_string(RECONNECT_TEXT, name, miles, hours, F.col("reconnect_node"), added),
        )
        .when(F.col("safe"), F.format_string(NEARBY_TEXT, name, miles, hours, backtrack))
        .otherwise(F.format_string(EMERGENCY_TEXT, name, miles))
    )
    return ranking.filter(F.col("rank") == 1).select(
        "entity_id",
        "ttf_hours",
        F.bround(F.col("ttf_hours") * SAFETY_FACTOR * SPEED_MPH, 0).cast("long").alias("max_safe_miles"),
        F.bround("position_miles", 1).alias("truck_position_miles"),
        "center_id",
        "name",
        "distance_mi",
        "drive_hrs",
        "detour_mi",
        "via",
        reasoning.alias("reasoning"),
    )


def drive_geometry(pairs: DataFrame, paths: DataFrame, geometry: DataFrame, nodes: DataFrame) -> DataFrame:
    """Road points of the drive between two nodes, one row per point.

    ``pairs``: from_node_id, to_node_id. Uses the stored line of that drive, else the stored
    line of the opposite drive turned round, else straight lines over the path nodes. A drive
    that goes nowhere has no points.
    """
    keys = ["from_node_id", "to_node_id"]
    sizes = geometry.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    forward = sizes.select(*keys, F.lit(True).alias("_fwd"))
    turned = {"from_node_id": "to_node_id", "to_node_id": "from_node_id"}
    reverse = sizes.select(*[F.col(turned[k]).alias(k) for k in keys], F.col("_n").alias("_rev"))
    kind = F.when(F.col("_fwd"), "FORWARD").when(F.col("_rev").isNotNull(), "REVERSED").otherwise("NODES")
    sourced = (
        pairs.select(*keys)
        .distinct()
        .join(forward, keys, "left")
        .join(reverse, keys, "left")
        .select(*keys, kind.alias("kind"), "_rev")
    )
    line = geometry.select(*keys, "pos", "lon", "lat")
    straight = (
        sourced.filter(F.col("kind") == "NODES")
        .join(paths.select(F.col("source").alias("from_node_id"), F.col("target").alias("to_node_id"), "path"), keys)
        .filter(F.size("path") > 1)
        .select(*keys, "kind", F.posexplode("path").alias("pos", "node_id"))
        .join(nodes.select("node_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")), "node_id")
        .select(*keys, "kind", F.col("pos").cast("long").alias("pos"), "lon", "lat")
    )
    along = sourced.filter(F.col("kind") == "FORWARD").join(line, keys).select(*keys, "kind", "pos", "lon", "lat")
    against = (
        sourced.filter(F.col("kind") == "REVERSED")
        .join(line.select(*[F.col(turned[k]).alias(k) for k in keys], "pos", "lon", "lat"), keys)
        .select(*keys, "kind", (F.col("_rev") - 1 - F.col("pos")).alias("pos"), "lon", "lat")
    )
    return along.unionByName(against).unionByName(straight)


def reconnect_geometry(pairs: DataFrame, paths: DataFrame, geometry: DataFrame, nodes: DataFrame) -> DataFrame:
    """Road points from a center node back to the route. ``pairs``: center_node, reconnect_node."""
    names = {"center_node": "from_node_id", "reconnect_node": "to_node_id"}
    drawn = drive_geometry(pairs.withColumnsRenamed(names), paths, geometry, nodes)
    return drawn.withColumnsRenamed({v: k for k, v in names.items()})


def detour_geometry(found: DataFrame, spots: DataFrame, paths: DataFrame, geometry: DataFrame, nodes: DataFrame) -> DataFrame:
    """The line of each detour found: the truck's own place, then the drive to the center's node.

    ``found``: entity_id, from_node_id, to_center_id, to_center_node_id; ``spots``: entity_id, latitude, longitude.
    """
    keys = ["entity_id", "to_center_id"]
    asked = found.select(*keys, "from_node_id", F.col("to_center_node_id").alias("to_node_id"))
    drawn = drive_geometry(asked, paths, geometry, nodes)
    road = asked.join(drawn, ["from_node_id", "to_node_id"]).select(*keys, (F.col("pos") + 1).alias("pos"), "lon", "lat")
    start = asked.join(spots, "entity_id").select(
        *keys, F.lit(0).cast("long").alias("pos"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat")
    )
    return start.unionByName(road)


def detour_lookup(
    waypoints: DataFrame,
    routes: DataFrame,
    path_nodes: DataFrame,
    nodes: DataFrame,
    detours: DataFrame,
    epoch: int,
    direction_aware: bool = False,
    requests: DataFrame | None = None,
) -> DataFrame:
    """Stored detours (of ``detour_table``) from the path node nearest to each truck, to the centers it asks for.

    ``requests`` (entity_id, to_center_id) names the pairs asked for; without it a truck gets
    the detours to every center. By default the truck stands at the miles driven since the start, return legs ignored;
    ``direction_aware`` uses its position on the current leg.
    """
    if direction_aware:
        targets = leg_position(route_extent(waypoints), None, epoch).select("entity_id", "target_miles")
    else:
        targets = routes.select("entity_id", F.lit(epoch * MILES_PER_EPOCH).alias("target_miles"))
    if requests is not None:
        targets = targets.join(requests.select("entity_id").distinct(), "entity_id", "left_semi")
    spots = nearest_mile(waypoints, targets)
    start = nearest_path_node(spots, path_nodes, nodes).select("entity_id", F.col("node_id").alias("from_node_id"))
    if requests is None:
        found = start.join(detours, "from_node_id")
    else:
        asked = start.join(requests.select("entity_id", "to_center_id").distinct(), "entity_id")
        found = asked.join(detours, ["from_node_id", "to_center_id"])
    return (
        found.select("entity_id", "from_node_id", "to_center_id", "to_center_node_id", "distance_miles", "duration_hours", "path_nodes")
    )
