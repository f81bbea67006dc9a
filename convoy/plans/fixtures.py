"""Fleet tables derived from the given business tables, by fixed arithmetic rules.

``events`` become telemetry, seeds and waypoints; customers, suppliers, orders and line
items become a road graph whose nodes are nations; suppliers become service centers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.timeslice import epoch_seconds
from convoy.operators.blocks import balanced_width, running_sums
from convoy.plans.parameters import FLEET_SIZE, SERIES_EPOCH, STRETCH_SLICES, WIDTH_MINUTES
from convoy.settings import CLASS_LABELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truck_id(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("TRUCK_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def truck_number() -> Column:
    return F.substring("entity_id", 7, 12).cast("long")


def node_id(number: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(number.cast("string"), 2, "0"))


def with_measures(events: DataFrame, fleet_size: int | None = FLEET_SIZE) -> DataFrame:
    """Events as sensor readings; without ``fleet_size`` every user is an entity."""
    number = F.col("user_id") if fleet_size is None else F.pmod("user_id", F.lit(fleet_size)) + 1
    return events.select(
        truck_id(number).alias("entity_id"),
        "ts",
        F.col("value").alias("engine_temp"),
        F.get_json_object("props", "$.k").cast("double").alias("trans_oil_pressure"),
        (11 + F.pmod(F.col("event_id") * 7919, F.lit(300)) / 100.0).alias("battery_voltage"),
        "event_id",
        "event_type",
    )


def telemetry(spark: SparkSession, sf_dir: str, fleet_size: int | None = FLEET_SIZE) -> DataFrame:
    return with_measures(table(spark, sf_dir, "events"), fleet_size).drop("event_id", "event_type")


def training(spark: SparkSession, sf_dir: str, fleet_size: int | None = FLEET_SIZE) -> DataFrame:
    """Readings of trucks that fail in stretches: the class of a truck and stretch, and its mark.

    Engines run hot, transmissions lose pressure upwards, batteries swing. In every fifth
    stretch a quarter of the readings belong to the next class, so some slices are mixed.
    """
    n = truck_number()
    stretch = F.floor(epoch_seconds(F.col("ts")) / (WIDTH_MINUTES * 60 * STRETCH_SLICES))
    mixed = (F.pmod(stretch * 7 + n, F.lit(5)) == 0) & (F.pmod("event_id", F.lit(4)) == 0)
    index = F.pmod(stretch * 5 + n * 3 + mixed.cast("long"), F.lit(4))
    labels = F.array(*[F.lit(label) for label in CLASS_LABELS])
    return (
        with_measures(table(spark, sf_dir, "events"), fleet_size)
        .withColumn("_class", index.cast("int"))
        .withColumn("engine_temp", F.col("engine_temp") + F.when(F.col("_class") == 1, 150.0).otherwise(0.0))
        .withColumn("trans_oil_pressure", F.col("trans_oil_pressure") + F.when(F.col("_class") == 2, 120.0).otherwise(0.0))
        .withColumn("battery_voltage", 11 + (F.col("battery_voltage") - 11) * F.when(F.col("_class") == 3, 4.0).otherwise(1.0))
        .withColumn("failure_type", labels[F.col("_class")])
        .withColumn("time_to_failure", 2.0 + F.floor(F.col("engine_temp") / 20) + F.floor(F.col("trans_oil_pressure") / 25))
        .drop("event_id", "event_type", "_class")
    )


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with their position per entity and the running sum of the pressure."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    readings = (
        with_measures(events)
        .drop("event_type")
        .withColumn("_block", F.floor(micros / balanced_width(events, micros)))
        .withColumn("_one", F.lit(1).cast("long"))
    )
    return running_sums(readings, ["entity_id"], "_block", ["ts", "event_id"], ["_one", "trans_oil_pressure"])


def baseline_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select(
        "entity_id", F.col("_run__one").alias("epoch"), "engine_temp", "trans_oil_pressure", "battery_voltage"
    )


def override_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events")
    readings = (
        with_measures(events)
        .filter(kind.isin("purchase", "signup", "error"))
        .withColumn(
            "failure_type",
            F.when(kind == "purchase", "ENGINE").when(kind == "signup", "TRANSMISSION").otherwise("ELECTRICAL"),
        )
        .withColumn("_block", F.floor(F.col("event_id") / balanced_width(events, F.col("event_id"))))
        .withColumn("_one", F.lit(1).cast("long"))
        .drop("event_type", "entity_id", "ts")
    )
    return running_sums(readings, ["failure_type"], "_block", ["event_id"], ["_one"]).select(
        "failure_type", F.col("_run__one").alias("epoch"), "engine_temp", "trans_oil_pressure", "battery_voltage"
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "events").select((F.pmod("user_id", F.lit(FLEET_SIZE)) + 1).alias("n")).distinct()
    return numbers.select(truck_id(F.col("n")).alias("entity_id"))


def failure_config(spark: SparkSession, sf_dir: str, epoch: int = SERIES_EPOCH) -> DataFrame:
    """Six configured entities: effective, future, exhausted, disabled, null cursor, unknown type."""
    n = truck_number()
    return (
        entities(spark, sf_dir)
        .filter(n <= 6)
        .select(
            "entity_id",
            F.when(n.isin(1, 4), "ENGINE").when(n == 2, "TRANSMISSION").when(n == 6, "COOLANT").otherwise("ELECTRICAL").alias("failure_type"),
            (n != 4).alias("enabled"),
            F.when(n == 2, epoch + 20).when(n == 5, epoch + 1).otherwise(epoch - 10).cast("long").alias("effective_from_epoch"),
            F.when(n == 3, 1_000_000_000).when(n == 5, None).otherwise(n * 3).cast("long").alias("failure_next_epoch"),
        )
    )


def breakdown_markers(spark: SparkSession, sf_dir: str, epoch: int = SERIES_EPOCH) -> DataFrame:
    """Truck 7 broke down before the clock, 8 and 1 do later (8 under two types), 9 never."""
    n = truck_number()
    rows = entities(spark, sf_dir).filter(n.isin(1, 7, 8, 9))
    first = rows.withColumn("failure_type", F.lit("ENGINE_FAILURE")).withColumn(
        "breakdown_epoch", F.when(n == 7, epoch - 5).when(n == 8, epoch + 50).when(n == 1, epoch + 80).cast("long")
    )
    second = rows.filter(n == 8).withColumn("failure_type", F.lit("ELECTRICAL_FAILURE")).withColumn(
        "breakdown_epoch", F.lit(epoch + 60).cast("long")
    )
    return first.unionByName(second)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        node_id(n).alias("node_id"),
        F.col("n_name").alias("name"),
        (25 + F.pmod(n * 7, F.lit(24))).cast("double").alias("latitude"),
        (F.pmod(n * 11, F.lit(57)) - 124).cast("double").alias("longitude"),
    )


def edge_texts(edges: DataFrame) -> DataFrame:
    """Roads with their line as GeoJSON text; of seven one is cut short, one null and one without points."""
    text, turn = F.to_json("road_geometry_sampled"), F.pmod("edge_id", F.lit(7))
    broken = F.when(turn == 0, F.left(text, F.length(text) / 2)).when(turn == 2, '{"type":"LineString","coordinates":[]}').when(turn > 2, text)
    return edges.select("edge_id", "from_node", "to_node", broken.alias("geometry"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One road per pair of nations that ship to each other, some stored backwards."""
    shipped = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", F.col("s_nationkey").cast("long").alias("b"))
    )
    placed = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", F.col("c_nationkey").cast("long").alias("a"))
    )
    a, b = F.col("a"), F.col("b")
    lanes = (
        shipped.join(placed, (F.col("l_orderkey") == F.col("o_orderkey")) & (a != b))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    backwards = F.pmod(a + b, F.lit(2)) == 1
    lanes = lanes.select(
        (a * 100 + b).alias("edge_id"),
        F.when(backwards, b).otherwise(a).alias("f"),
        F.when(backwards, a).otherwise(b).alias("t"),
        (100 + F.pmod(a * 37 + b * 61, F.lit(400))).cast("double").alias("miles"),
    )

    def lat(n: Column) -> Column:
        return 25 + F.pmod(n * 7, F.lit(24))

    def lon(n: Column) -> Column:
        return F.pmod(n * 11, F.lit(57)) - 124

    f, t = F.col("f"), F.col("t")
    points = [
        F.array((lon(f) * (3 - i) + lon(t) * i) / 3.0, (lat(f) * (3 - i) + lat(t) * i) / 3.0) for i in range(4)
    ]
    return lanes.select(
        "edge_id",
        node_id(f).alias("from_node"),
        node_id(t).alias("to_node"),
        "miles",
        F.struct(F.lit("LineString").alias("type"), F.array(*points).alias("coordinates")).alias("road_geometry_sampled"),
    )


def adjacency(road_edges: DataFrame) -> DataFrame:
    """Both directions of every road."""
    there = road_edges.select("from_node", "to_node", "miles")
    back = road_edges.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "miles")
    return there.unionByName(back)


def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        entities(spark, sf_dir)
        .withColumn("sequence_num", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
        .withColumn("node_id", node_id(F.pmod(truck_number() * 3 + F.col("sequence_num") * 4, F.lit(25))))
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = truck_number()
    origin, destination = F.pmod(n * 3, F.lit(25)), F.pmod(n * 3 + 20, F.lit(25))
    return entities(spark, sf_dir).select(
        "entity_id",
        F.concat(F.lit("Route "), n.cast("string")).alias("route_name"),
        F.concat(F.lit("City "), origin.cast("string")).alias("start_city"),
        F.concat(F.lit("City "), destination.cast("string")).alias("end_city"),
    )


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.col("_run__one")
    return _numbered(spark, sf_dir).select(
        "entity_id",
        epoch.alias("epoch"),
        (25 + F.pmod(epoch * 7, F.lit(2400)) / 100.0).alias("latitude"),
        (F.pmod(epoch * 11, F.lit(5700)) / 100.0 - 124).alias("longitude"),
        F.pmod(epoch * 13, F.lit(360)).cast("double").alias("heading"),
        F.col("_run_trans_oil_pressure").alias("miles_from_start"),
    )


def service_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey").cast("long")
    offset = F.pmod("s_suppkey", F.lit(50)) / 100.0
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("center_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("City "), n.cast("string")).alias("city"),
        F.concat(F.lit("S"), F.pmod(n, F.lit(5)).cast("string")).alias("state_code"),
        (25 + F.pmod(n * 7, F.lit(24)) + offset).alias("latitude"),
        (F.pmod(n * 11, F.lit(57)) - 124 + offset).alias("longitude"),
        node_id(n).alias("node_id"),
    )


def detour_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every center asks for the detour of one truck."""
    number = F.pmod("s_suppkey", F.lit(FLEET_SIZE)) + 1
    return table(spark, sf_dir, "supplier").select(truck_id(number).alias("entity_id"), F.col("s_suppkey").alias("to_center_id"))
