"""Fleet reports: status, freshness, charts, counters, positions on the route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convoy.functions.timeslice import boundaries_crossed, ntz, slice_end
from convoy.operators.features import MEASURES, newest_points, slice_aggregate
from convoy.settings import MILES_PER_EPOCH, Clock

# Limits of the reports.
ONLINE_SECONDS = 10
GREEN_MINUTES, RED_MINUTES = 5, 60
CHART_FORMAT = "yyyy-MM-dd HH:mm:ss"
KEY_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"

#: Width of the blocks in which waypoints are looked up by mile.
BLOCK_MILES = 100.0


def recent_rows(telemetry: DataFrame, clock: Clock) -> DataFrame:
    """Rows of the last two steps; the bound is a constant, so the scan prunes on it."""
    return telemetry.filter(F.col("ts") >= ntz(clock.recent_from))


def fleet_status(entities: DataFrame, telemetry: DataFrame, markers: DataFrame, clock: Clock) -> DataFrame:
    """Every entity with its newest recent reading; ONLINE within 10 seconds of the fleet's newest."""
    recent = recent_rows(telemetry, clock)
    newest = recent.select(F.max("ts")).scalar()
    latest = newest_points(recent.select("entity_id", "ts", *MEASURES))
    broken = (
        markers.filter(F.col("breakdown_epoch") <= clock.next_epoch)
        .select("entity_id")
        .distinct()
        .withColumn("_broken", F.lit(True))
    )
    close = boundaries_crossed("SECOND", F.col("ts"), newest) <= ONLINE_SECONDS
    status = F.when(close & F.col("_broken").isNull(), "ONLINE").otherwise("OFFLINE")
    return (
        entities.select("entity_id")
        .distinct()
        .join(latest, "entity_id", "left")
        .join(broken, "entity_id", "left")
        .select("entity_id", status.alias("status"), "ts", *MEASURES)
        .orderBy("entity_id")
    )


def prediction_freshness(predictions: DataFrame, telemetry: DataFrame, clock: Clock) -> DataFrame:
    """Age of each stored prediction against the newest recent reading, with its colour."""
    newest = recent_rows(telemetry, clock).select(F.max("ts")).scalar()
    # A prediction made after the newest reading is as fresh as can be.
    age = F.greatest(boundaries_crossed("MINUTE", F.col("prediction_timestamp"), F.col("latest_telemetry_time")), F.lit(0))
    known = F.col("latest_telemetry_time").isNotNull() & F.col("prediction_timestamp").isNotNull()
    colour = F.when(known & (age < RED_MINUTES), F.when(age <= GREEN_MINUTES, "green").otherwise("orange")).otherwise("red")
    return (
        predictions.withColumn("latest_telemetry_time", newest)
        .select(
            "entity_id",
            "prediction_timestamp",
            "predicted_failure_type",
            "predicted_hours_to_failure",
            "ttf_model_used",
            "last_updated",
            "latest_telemetry_time",
            F.when(known, age).otherwise(0).cast("long").alias("age_minutes"),
            colour.alias("age_color"),
            F.concat("entity_id", F.lit("_"), F.date_format("last_updated", KEY_FORMAT)).alias("prediction_key"),
        )
        .orderBy("entity_id")
    )


def refresh_due(freshness: DataFrame) -> DataFrame:
    """One row telling whether the oldest prediction calls for a refresh."""
    return freshness.agg(F.coalesce(F.max("age_minutes") >= RED_MINUTES, F.lit(False)).alias("refresh_due"))


def fleet_counters(telemetry: DataFrame, predictions: DataFrame) -> DataFrame:
    """Reporting entities, and entities whose class is not NORMAL."""
    failing = F.coalesce("predicted_failure_type", F.lit("NORMAL")) != "NORMAL"
    alerts = predictions.filter(failing).agg(F.countDistinct("entity_id").alias("n")).scalar()
    return telemetry.agg(F.countDistinct("entity_id").alias("trucks")).withColumn("alerts", alerts)


def _chart_rows(slices: DataFrame, limit: int | None) -> DataFrame:
    """The earliest slices first, entities break ties; with ``limit`` only so many rows."""
    ordered = slices.orderBy("bucket_time", "entity_id")
    return (ordered if limit is None else ordered.limit(limit)).select(
        F.date_format("bucket_time", CHART_FORMAT).alias("timestamp"),
        "entity_id",
        *[F.col(f"avg_{m}").alias(m) for m in MEASURES],
    )


def _hours(hours: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(hours))


def chart_data(telemetry: DataFrame, hours: int, width_minutes: int = 5, limit: int | None = None) -> DataFrame:
    """Slice averages of the last ``hours``, counted back from the newest slice end.

    Whole slices are kept or left out: those that start no earlier than one width before the
    bound. No point of theirs is older either, so the scan skips what is.
    """
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(width_minutes))
    newest = slice_end(F.max("ts"), width_minutes * 60)
    earliest = telemetry.select(newest - _hours(hours) - width).scalar()
    slices = slice_aggregate(telemetry.filter(F.col("ts") >= earliest), width_minutes)
    return _chart_rows(slices.filter(F.col("bucket_time") - width >= earliest), limit)


def chart_data_raw(telemetry: DataFrame, hours: int, width_minutes: int = 5, limit: int | None = None) -> DataFrame:
    """As ``chart_data`` but cut by point time, so the first slice may be partial."""
    bound = telemetry.select(F.max("ts") - _hours(hours)).scalar()
    return _chart_rows(slice_aggregate(telemetry.filter(F.col("ts") >= bound), width_minutes), limit)


def marker_listing(markers: DataFrame) -> DataFrame:
    return markers.select(
        "entity_id", F.date_format("first_failure_time", CHART_FORMAT).alias("first_failure_time"), "failure_type"
    ).orderBy("entity_id", "failure_type")


def dataset_profile(rows: DataFrame) -> DataFrame:
    """Row count, engine temperature checksum and entity count per ``table_name``, largest first.

    Several tables are profiled as their union, each under its name.
    """
    return (
        rows.groupBy("table_name")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.round(F.sum("engine_temp"), 2).alias("total_engine_temp"),
            F.countDistinct("entity_id").alias("entities"),
        )
        .orderBy(F.desc("row_count"), "table_name")
    )


def route_extent(waypoints: DataFrame) -> DataFrame:
    return waypoints.groupBy("entity_id").agg(
        F.max("miles_from_start").alias("route_miles"), F.max("epoch").alias("max_epoch")
    )


def leg_position(extents: DataFrame, markers: DataFrame | None, epoch: int) -> DataFrame:
    """Where an entity shuttling along its route stands; a broken-down one stays put.

    Two markers of one entity count as the earlier breakdown; without ``markers`` none broke.
    """
    if markers is None:
        frozen = extents.withColumn("_broken", F.lit(None).cast("long"))
    else:
        broken = (
            markers.filter(F.col("breakdown_epoch").isNotNull())
            .groupBy("entity_id")
            .agg(F.min("breakdown_epoch").alias("_broken"))
        )
        frozen = extents.join(broken, "entity_id", "left")
    driven = F.coalesce(F.col("_broken"), F.lit(epoch)) * MILES_PER_EPOCH
    length = F.nullif("route_miles", F.lit(0.0))
    returning = F.col("is_return_trip")
    return (
        frozen.withColumn("total_miles_driven", driven)
        .withColumn("legs_completed", F.floor(F.col("total_miles_driven") / length))
        .withColumn("miles_this_leg", F.col("total_miles_driven") % length)
        .withColumn("is_return_trip", F.col("legs_completed") % 2 == 1)
        .withColumn("is_broken_down", F.col("_broken").isNotNull())
        .withColumn(
            "target_miles",
            F.when(returning, F.col("route_miles") - F.col("miles_this_leg")).otherwise(F.col("miles_this_leg")),
        )
        .drop("_broken")
    )


def _mile_block(miles: Column) -> Column:
    return F.floor(miles / BLOCK_MILES)


def mile_blocks(waypoints: DataFrame) -> DataFrame:
    """One row per entity and block of miles that holds waypoints.

    ``_low`` and ``_high`` are its first and last mile, ``_after`` the first mile of the next
    such block, ``route_miles`` the end of the route. Two columns are read and two numbers per
    block are combined on the map side, so a busy entity is a few rows before it moves.
    """
    miles = F.col("miles_from_start")
    ends = (
        waypoints.filter(miles.isNotNull())
        .groupBy("entity_id", _mile_block(miles).alias("_block"))
        .agg(F.min(miles).alias("_low"), F.max(miles).alias("_high"))
    )
    route = W.partitionBy("entity_id")
    return ends.select(
        "entity_id",
        "_low",
        "_high",
        F.lag("_low").over(route.orderBy("_block")).isNull().alias("_is_first"),
        F.lead("_low").over(route.orderBy("_block")).alias("_after"),
        F.max("_high").over(route).alias("route_miles"),
    )


def _bracketed(blocks: DataFrame) -> DataFrame:
    """Of blocks with ``target_miles``, the one the target falls behind the start of (else the first).

    Its nearest waypoint is in this block or is the first of the next one, and is no farther
    than ``_gap``, the least gap among their known ends.
    """
    target = F.col("target_miles")
    here = (F.col("_is_first") | (target >= F.col("_low"))) & (F.col("_after").isNull() | (target < F.col("_after")))
    gap = F.least(*[F.abs(F.col(c) - target) for c in ("_low", "_high", "_after")])
    return blocks.filter(here).withColumn("_gap", gap).filter(F.col("_gap").isNotNull())


def _waypoint_at(waypoints: DataFrame, bracketed: DataFrame) -> DataFrame:
    gap = F.abs(F.col("miles_from_start") - F.col("target_miles"))
    wanted = bracketed.select(
        "entity_id",
        "target_miles",
        "_gap",
        F.explode(F.array_distinct(F.array_compact(F.array(_mile_block(F.col("_low")), _mile_block(F.col("_after")))))).alias("_block"),
    )
    marks = waypoints.select(
        "entity_id", "miles_from_start", "epoch", "latitude", "longitude", "heading",
        _mile_block(F.col("miles_from_start")).alias("_block"),
    )
    best = F.min(F.struct(gap.alias("_gap"), "epoch", "latitude", "longitude", "heading"))
    return (
        marks.join(wanted, ["entity_id", "_block"])
        .filter(gap <= F.col("_gap"))
        .groupBy("entity_id")
        .agg(best.alias("_w"))
        .select("entity_id", *[f"_w.{c}" for c in ("epoch", "latitude", "longitude", "heading")])
    )


def nearest_mile(waypoints: DataFrame, targets: DataFrame) -> DataFrame:
    """Per entity the waypoint nearest to ``target_miles``; ties go to the lowest epoch.

    Blocks of miles are matched first, as an as-of lookup: the block a target falls into and
    the start of the next one bound its gap. Waypoints then meet targets by entity and block,
    so the join is broadcast if targets are few, and spreads a hot entity over its blocks if
    not; only waypoints within the bound are compared as rows.
    """
    wanted = targets.select("entity_id", "target_miles")
    return _waypoint_at(waypoints, _bracketed(mile_blocks(waypoints).join(wanted, "entity_id")))


def truck_positions(
    routes: DataFrame, waypoints: DataFrame, markers: DataFrame, predictions: DataFrame, epoch: int
) -> DataFrame:
    """Position, heading, progress and prediction of every truck at ``epoch``.

    Waypoints are read twice and joined once: their miles by blocks, which give the length of
    a route as well as the bracket of a position, and then the rows inside the brackets.
    """
    described = routes.select("entity_id", "route_name", F.col("start_city").alias("_start"), F.col("end_city").alias("_end"))
    placed = _bracketed(leg_position(mile_blocks(waypoints), markers, epoch)).join(described, "entity_id")
    matched = _waypoint_at(waypoints, placed)
    stored = predictions.select("entity_id", "predicted_failure_type", "predicted_hours_to_failure")
    returning = F.col("is_return_trip")
    share = F.col("miles_this_leg") / F.nullif("route_miles", F.lit(0.0))
    first = F.when(returning, F.col("_end")).otherwise(F.col("_start"))
    second = F.when(returning, F.col("_start")).otherwise(F.col("_end"))
    hours = F.col("predicted_hours_to_failure")
    return (
        placed.join(matched, "entity_id")
        .join(stored, "entity_id", "left")
        .select(
            "entity_id",
            "latitude",
            "longitude",
            F.when(returning, (F.col("heading") + 180) % 360).otherwise(F.col("heading")).alias("heading"),
            F.round(F.col("miles_this_leg") / F.col("route_miles") * 100, 1).alias("percent_complete"),
            F.concat(first, F.lit(" > "), second).alias("route_display"),
            "route_name",
            first.alias("start_city"),
            second.alias("end_city"),
            "route_miles",
            F.round("miles_this_leg", 0).alias("miles_driven"),
            F.round(F.col("route_miles") - F.col("miles_this_leg"), 1).alias("miles_to_destination"),
            "is_return_trip",
            "legs_completed",
            "is_broken_down",
            F.when(share > 0.98, "ARRIVING")
            .when((share < 0.02) & (F.col("legs_completed") > 0), "JUST_TURNED")
            .when(returning, "RETURNING")
            .otherwise("OUTBOUND")
            .alias("trip_phase"),
            F.coalesce("predicted_failure_type", F.lit("NORMAL")).alias("failure_type"),
            F.when(hours >= 0, F.round(hours, 1)).alias("ttf_hours"),
        )
    )
