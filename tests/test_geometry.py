"""Lines from broken text, and lines folded from many points."""

from pyspark.sql import functions as F

from convoy.operators import geometry, routes

TEXTS = {
    1: ('{"type":"LineString","coordinates":[[1.5,2.5],[3.0,4.0,9.0]]}', None),
    2: ('{"type":"LineString","coordinates":[[1.5,2.5],[3.', "MALFORMED"),
    3: (None, "MISSING"),
    4: ("   ", "MISSING"),
    5: ("no json", "MALFORMED"),
    6: ('{"type":"LineString","coordinates":[[1.0,2.0]]}', "NOT_A_LINE"),
    7: ('{"type":"MultiPoint","coordinates":[[1.0,2.0],[3.0,4.0]]}', "NOT_A_LINE"),
    8: ('{"type":"LineString","coordinates":[[1.0],[3.0,4.0]]}', "NOT_A_LINE"),
    9: ('{"type":"LineString","coordinates":[null,[3.0,4.0]]}', "NOT_A_LINE"),
    10: ('{"type":"LineString"}', "NOT_A_LINE"),
    11: ('{"type":"LineString","coordinates":[["a","b"],[3.0,4.0]]}', "MALFORMED"),
    12: ("{}", "NOT_A_LINE"),
}


def roads(spark):
    rows = [(i, "A", "B" if i != 5 else "X", text) for i, (text, _) in TEXTS.items()]
    return spark.createDataFrame(rows, "edge_id int, from_node string, to_node string, geometry string")


def test_lines_are_parsed_or_rejected(spark):
    nodes = spark.createDataFrame([("A", 10.0, 20.0), ("B", 11.0, 21.0)], "node_id string, latitude double, longitude double")
    found = {r.edge_id: r for r in geometry.road_lines(roads(spark), nodes).collect()}
    assert {i: r.reject for i, r in found.items()} == {i: reject for i, (_, reject) in TEXTS.items()}
    assert found[1].line == [[1.5, 2.5], [3.0, 4.0]]
    assert found[5].line is None
    assert all(found[i].line == [[20.0, 10.0], [21.0, 11.0]] for i in TEXTS if i not in (1, 5))


def test_rejects_keep_their_text(spark):
    found = {r.edge_id: r.geometry for r in geometry.rejected_lines(roads(spark)).collect()}
    assert found == {i: text for i, (text, reject) in TEXTS.items() if reject}
    assert geometry.rejected_lines(roads(spark).limit(0)).count() == 0


def test_a_line_of_a_million_points_keeps_its_order(spark):
    points = spark.range(1_000_000).select(
        F.when(F.col("id") < 999_000, "long").otherwise("short").alias("entity_id"), F.col("id").alias("pos"), F.col("id").cast("double").alias("lon"), (-F.col("id")).cast("double").alias("lat")
    ).repartition(8, "pos")
    line = F.col("geometry.coordinates")
    inner = F.sequence(F.lit(1), F.size(line) - 1)
    steps = F.forall(inner, lambda i: line[i][0] == line[i - 1][0] + 1)
    found = {r.entity_id: (r.point_count, r.n, r.ordered) for r in routes.as_linestring(points, ["entity_id"]).select("entity_id", "point_count", F.size(line).alias("n"), steps.alias("ordered")).collect()}
    assert found == {"long": (999_000, 999_000, True), "short": (1_000, 1_000, True)}
