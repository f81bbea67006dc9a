"""Road geometry that comes as GeoJSON text, some of it broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "type STRING, coordinates ARRAY<ARRAY<DOUBLE>>, _corrupt STRING"


def parse_lines(roads: DataFrame, text_col: str = "geometry") -> DataFrame:
    """Roads with ``line``, an array of [lon, lat], and ``reject``, the reason why there is none.

    MISSING: null or blank text. MALFORMED: no JSON of that shape, as a text cut short. NOT_A_LINE:
    another type, fewer than two points, or a point without both numbers. No text stops the job.
    """
    text = F.trim(F.col(text_col).cast("string"))
    parsed = F.from_json(text, LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    points = F.col("_parsed.coordinates")
    placed = F.forall(points, lambda q: F.coalesce(F.get(q, 0).isNotNull() & F.get(q, 1).isNotNull(), F.lit(False)))
    good = (F.col("_parsed.type") == "LineString") & (F.size(points) >= 2) & placed
    reject = (
        F.when(text.isNull() | (text == ""), "MISSING")
        .when(F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull(), "MALFORMED")
        .when(~F.coalesce(good, F.lit(False)), "NOT_A_LINE")
    )
    found = roads.withColumn("_parsed", parsed).withColumn("reject", reject)
    line = F.when(F.col("reject").isNull(), F.transform(points, lambda q: F.slice(q, 1, 2)))
    return found.withColumn("line", line).drop("_parsed")


def road_lines(roads: DataFrame, nodes: DataFrame, text_col: str = "geometry") -> DataFrame:
    """Roads with a line each: their own, or the straight one between their nodes where it is rejected.

    ``roads`` carry from_node and to_node; a rejected road keeps its ``reject``, and has no line
    if one of its nodes is unknown.
    """

    def ends(side: str):
        return nodes.select(F.col("node_id").alias(f"{side}_node"), F.array("longitude", "latitude").alias(f"_{side}"))

    placed = parse_lines(roads, text_col).join(ends("from"), "from_node", "left").join(ends("to"), "to_node", "left")
    straight = F.when(F.col("_from").isNotNull() & F.col("_to").isNotNull(), F.array("_from", "_to"))
    return placed.withColumn("line", F.coalesce("line", straight)).drop("_from", "_to")


def rejected_lines(roads: DataFrame, text_col: str = "geometry") -> DataFrame:
    """The roads without a usable line, with the text as it came."""
    return parse_lines(roads, text_col).filter("reject IS NOT NULL").drop("line")
