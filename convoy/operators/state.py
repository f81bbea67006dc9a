"""Keyed state as pure rewrites: old state and input in, new state out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.timeslice import ntz, slice_start
from convoy.operators.features import latest_per_entity
from convoy.schemas import CLOCK
from convoy.settings import BREAKDOWN_HOURS, RETENTION_HOURS, STEP_SECONDS

PREDICTION_FIELDS = [
    "prediction_timestamp",
    "predicted_failure_type",
    "predicted_hours_to_failure",
    "ttf_model_used",
    "current_engine_temp",
    "current_trans_pressure",
    "current_battery_voltage",
]


def _instant(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else ntz(as_of)


def _whole(epoch: int | Column) -> Column:
    return (epoch if isinstance(epoch, Column) else F.lit(epoch)).cast("long")


def prediction_upsert(state: DataFrame, incoming: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Latest prediction per entity: matched rows overwritten, new ones added, others kept.

    Of several incoming rows of one entity the newest counts.
    """
    newest = latest_per_entity(incoming.select("entity_id", *PREDICTION_FIELDS), "prediction_timestamp")
    source = newest.select(F.col("entity_id").alias("_id"), F.struct(*PREDICTION_FIELDS).alias("_new"))
    arrived = F.col("_new").isNotNull()
    return state.join(source, F.col("entity_id") == F.col("_id"), "full_outer").select(
        F.coalesce("entity_id", "_id").alias("entity_id"),
        *[F.when(arrived, F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f) for f in PREDICTION_FIELDS],
        F.when(arrived, _instant(as_of)).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def latest_upsert(state: DataFrame, incoming: DataFrame, ts: str = "ts") -> DataFrame:
    """Newest reading per entity from the old state and new rows."""
    rest = [c for c in state.columns if c not in ("entity_id", ts)]
    return (
        state.unionByName(incoming)
        .groupBy("entity_id")
        .agg(F.max(F.struct(ts, *rest)).alias("_row"))
        .select(*[F.col("entity_id") if c == "entity_id" else F.col(f"_row.{c}").alias(c) for c in state.columns])
    )


def marker_maintenance(
    markers: DataFrame,
    predictions: DataFrame,
    as_of: datetime | Column,
    epoch: int | Column,
    width_minutes: int = 5,
) -> DataFrame:
    """First-failure markers after a refresh: insert, drop recovered entities, mark breakdowns.

    The grain is (entity, failure type): an entity whose class changes holds two markers.
    """
    failing = predictions.filter(F.col("predicted_failure_type") != "NORMAL")
    found = failing.select(
        "entity_id",
        slice_start(F.col("prediction_timestamp"), width_minutes * 60).alias("first_failure_time"),
        F.col("predicted_failure_type").alias("failure_type"),
        _instant(as_of).alias("last_updated"),
        F.lit(None).cast("long").alias("breakdown_epoch"),
    )
    inserted = markers.unionByName(found.join(markers, ["entity_id", "failure_type"], "left_anti"))
    kept = inserted.join(failing.select("entity_id"), "entity_id", "left_semi")
    imminent = (
        predictions.filter(F.col("predicted_hours_to_failure") <= BREAKDOWN_HOURS)
        .select("entity_id")
        .distinct()
        .withColumn("_imminent", F.lit(True))
    )
    return kept.join(imminent, "entity_id", "left").select(
        "entity_id",
        "first_failure_time",
        "failure_type",
        "last_updated",
        F.coalesce("breakdown_epoch", F.when(F.col("_imminent"), _whole(epoch))).alias("breakdown_epoch"),
    )


def breakdown_projection(
    markers: DataFrame, predictions: DataFrame, next_epoch: int, hours: float, step_seconds: int = STEP_SECONDS
) -> DataFrame:
    """Set open breakdown epochs of entities expected to fail within the next ``hours``."""
    ttf = F.col("predicted_hours_to_failure")
    due = predictions.filter(
        (F.col("predicted_failure_type") != "NORMAL") & (ttf > 0) & (ttf <= float(hours))
    ).select("entity_id", (next_epoch + (ttf * (3600 / step_seconds)).cast("long")).alias("_due"))
    return markers.join(due, "entity_id", "left").select(
        *[c for c in markers.columns if c != "breakdown_epoch"],
        F.coalesce("breakdown_epoch", "_due").alias("breakdown_epoch"),
    )


def config_upsert(config: DataFrame, activations: DataFrame, next_epoch: int) -> DataFrame:
    """Switch on an override per activated entity from the next epoch; its cursor is kept.

    An entity activated twice takes the type that sorts last.
    """
    source = activations.groupBy(F.col("entity_id").alias("_id")).agg(F.max(F.upper("failure_type")).alias("_type"))
    hit = F.col("_id").isNotNull()
    starting = F.lit(next_epoch + 1).cast("long")
    cursor = F.col("failure_next_epoch")
    return config.join(source, F.col("entity_id") == F.col("_id"), "full_outer").select(
        F.coalesce("entity_id", "_id").alias("entity_id"),
        F.when(hit, F.col("_type")).otherwise(F.col("failure_type")).alias("failure_type"),
        F.when(hit, True).otherwise(F.col("enabled")).alias("enabled"),
        F.when(hit, starting).otherwise(F.col("effective_from_epoch")).alias("effective_from_epoch"),
        F.when(hit, F.coalesce(cursor, F.lit(0))).otherwise(cursor).alias("failure_next_epoch"),
    )


def ensure_clock(clock: DataFrame, stream_name: str, as_of: datetime) -> DataFrame:
    """Add the named clock row when absent and fill its missing fields with defaults."""
    wanted = clock.sparkSession.range(1).select(
        F.lit(stream_name).alias("stream_name"),
        F.lit(None).cast("timestamp_ntz").alias("start_ts"),
        F.lit(None).cast("long").alias("next_epoch"),
        F.lit(None).cast("long").alias("step_seconds"),
        F.lit(None).cast("timestamp_ntz").alias("last_updated"),
    )
    grown = clock.unionByName(wanted.join(clock, "stream_name", "left_anti"))
    mine = F.col("stream_name") == stream_name

    def fill(name: str, default: Column) -> Column:
        return F.when(mine, F.coalesce(F.col(name), default)).otherwise(F.col(name))

    return grown.withColumns(
        {
            "start_ts": fill("start_ts", ntz(as_of)),
            "step_seconds": fill("step_seconds", F.lit(STEP_SECONDS).cast("long")),
            "next_epoch": fill("next_epoch", F.lit(0).cast("long")),
        }
    ).select(*clock.columns)


def cursor_advance_step(config: DataFrame, overrides: DataFrame, target_epoch: int) -> DataFrame:
    """Move each effective cursor by one where an override row waits at the next position.

    Entities that broke down advance as well.
    """
    ahead = F.coalesce("failure_next_epoch", F.lit(0)) + 1
    seeds = overrides.select(F.col("failure_type").alias("_type"), F.col("epoch").alias("_epoch")).distinct()
    live = F.col("enabled") & (F.col("effective_from_epoch") <= target_epoch)
    step = F.when(live, ahead)
    return (
        config.withColumn("_ahead", step)
        .join(seeds, (F.col("failure_type") == F.col("_type")) & (F.col("_ahead") == F.col("_epoch")), "left")
        .select(
            *[c for c in config.columns if c != "failure_next_epoch"],
            F.when(F.col("_epoch").isNotNull(), F.col("_ahead")).otherwise(F.col("failure_next_epoch")).alias("failure_next_epoch"),
        )
    )


def cursor_advance_backfill(config: DataFrame, next_epoch: int, epochs: int) -> DataFrame:
    """Move cursors past a backfilled range; not capped at the end of the override series."""
    effective = F.coalesce("effective_from_epoch", F.lit(0))
    last = next_epoch + epochs
    moved = F.when(effective > next_epoch, F.least(F.lit(epochs), last - effective + 1)).otherwise(F.lit(epochs))
    applies = F.col("enabled") & (effective <= last) & (moved > 0)
    cursor = F.col("failure_next_epoch")
    return config.withColumn(
        "failure_next_epoch", F.when(applies, F.coalesce(cursor, F.lit(0)) + moved).otherwise(cursor).cast("long")
    )


def retention_filter(telemetry: DataFrame, hours: int = RETENTION_HOURS) -> DataFrame:
    """Rows no older than ``hours`` before the newest one."""
    bound = telemetry.select(F.max("ts") - F.make_dt_interval(F.lit(0), F.lit(hours))).scalar()
    return telemetry.filter(F.col("ts") >= bound)


def reset_state(spark: SparkSession, schema: str) -> DataFrame:
    """An empty state of the given shape, to overwrite the old one with."""
    return spark.createDataFrame([], schema)


def reset_clock(spark: SparkSession, stream_name: str, as_of: datetime) -> DataFrame:
    return ensure_clock(reset_state(spark, CLOCK), stream_name, as_of)
