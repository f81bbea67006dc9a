"""Slice aggregates and the sixteen model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.timeslice import epoch_seconds
from convoy.operators.blocks import scan_blocks
from convoy.settings import CLASS_LABELS

MEASURES = ["engine_temp", "trans_oil_pressure", "battery_voltage"]

# The order of the model inputs.
BASIC_FEATURES = [
    "avg_engine_temp",
    "avg_trans_oil_pressure",
    "avg_battery_voltage",
    "stddev_battery_voltage",
    "stddev_engine_temp",
    "stddev_trans_oil_pressure",
    "slope_engine_temp",
    "slope_trans_oil_pressure",
    "slope_battery_voltage",
    "rolling_avg_engine_temp",
    "rolling_avg_trans_oil_pressure",
]
TEMPORAL_FEATURES = BASIC_FEATURES + [
    "cumulative_volatility",
    "elevated_window_count",
    "volatility_delta",
    "temp_acceleration",
    "pressure_acceleration",
]


def slice_aggregate(telemetry: DataFrame, width_minutes: int = 5) -> DataFrame:
    """Averages, count and newest timestamp per entity and slice, labelled by the slice end."""
    return (
        telemetry.groupBy(F.window("ts", f"{width_minutes} minutes").alias("slice"), "entity_id")
        .agg(
            *[F.avg(m).alias(f"avg_{m}") for m in MEASURES],
            F.count(F.lit(1)).alias("point_count"),
            F.max("ts").alias("latest_timestamp"),
        )
        .select(
            F.col("slice.end").alias("bucket_time"),
            "entity_id",
            *[f"avg_{m}" for m in MEASURES],
            "point_count",
            "latest_timestamp",
        )
    )


def _rolling_mean(name: str) -> Column:
    """Mean of this slice and the two before it, skipping nulls."""
    parts = [F.col(f"_prev2.{name}"), F.col(f"_prev1.{name}"), F.col(name)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    count = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.when(count > 0, total / count)


def _zero_if_null(value: Column, name: str) -> Column:
    return F.coalesce(value, F.lit(0)).alias(name)


def feature_slices(telemetry: DataFrame, width_minutes: int = 5, label: str | None = None) -> DataFrame:
    """Averages, sample deviations and row count per entity and slice, sparse slices included.

    Points are reduced by partial aggregation before any shuffle. ``label`` is as for
    ``temporal_features``. Labels are aggregated as numbers in their alphabetical order, since
    text could only be aggregated after a sort of all points.
    """
    names = sorted(CLASS_LABELS)
    listed = F.array(*[F.lit(n) for n in names])
    number = F.nullif(F.array_position(listed, F.col("failure_type")), F.lit(0))
    labels, failure_type = [], None
    if label == "max":
        labels = [F.max(number).alias("_label")]
        failure_type = listed[(F.col("_label") - 1).cast("int")]
    elif label == "mode":
        labels = [F.count(F.when(number == i + 1, 1)).alias(f"_label{i}") for i in range(len(names))]
        counts = F.array(*[f"_label{i}" for i in range(len(names))])
        failure_type = F.when(F.array_max(counts) > 0, listed[(F.array_position(counts, F.array_max(counts)) - 1).cast("int")])
    if label:
        labels.append(F.avg("time_to_failure").alias("time_to_failure"))
    slices = (
        telemetry.groupBy("entity_id", F.window("ts", f"{width_minutes} minutes").alias("slice"))
        .agg(
            F.max("ts").alias("feature_timestamp"),
            *[F.avg(m).alias(f"avg_{m}") for m in MEASURES],
            *[F.stddev_samp(m).alias(f"stddev_{m}") for m in MEASURES],
            F.count(F.lit(1)).alias("record_count"),
            *labels,
        )
        .withColumn("slice_start", F.col("slice.start"))
        .drop("slice")
    )
    if label is None:
        return slices
    return slices.withColumn("failure_type", failure_type).drop(*[c for c in slices.columns if c.startswith("_label")])


def temporal_features(
    telemetry: DataFrame,
    width_minutes: int = 5,
    min_records: int = 12,
    elevated_threshold: float = 0.7,
    slope_minutes: float | None = None,
    block_slices: int = 288,
    label: str | None = None,
) -> DataFrame:
    """The 16 features per entity and slice, for slices of at least ``min_records`` rows.

    ``label`` adds the slice's ``failure_type`` and mean ``time_to_failure``: "max" takes the
    lexicographic maximum (a slice mixing NORMAL and ENGINE_FAILURE counts as NORMAL), "mode"
    the most frequent type, of several the first. Types outside ``CLASS_LABELS`` do not count.
    """
    slices = feature_slices(telemetry, width_minutes, label)
    return features_of_slices(slices, width_minutes, min_records, elevated_threshold, slope_minutes, block_slices)


def features_of_slices(
    slices: DataFrame,
    width_minutes: int = 5,
    min_records: int = 12,
    elevated_threshold: float = 0.7,
    slope_minutes: float | None = None,
    block_slices: int = 288,
) -> DataFrame:
    """Features from slices.

    Sparse slices are dropped only after they have served as history for later ones. The
    previous slice is the previous one that exists, and slopes always divide by
    ``slope_minutes`` (the slice width), gaps or not. The ordered part works on blocks of
    ``block_slices`` slices, so a busy entity is spread over many tasks.
    """
    scanned = scan_slices(slices, width_minutes, elevated_threshold, block_slices)
    return features_of_scan(scanned, float(width_minutes if slope_minutes is None else slope_minutes), min_records)


HISTORY = [f"avg_{m}" for m in MEASURES] + ["stddev_battery_voltage"]


def scan_slices(
    slices: DataFrame, width_minutes: int, elevated_threshold: float, block_slices: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Slices with the two before them (``_prev1``, ``_prev2``) and the running sums.

    A slice with ``carried`` set stands for all up to it: its ``carried`` values (a struct of
    volatility and elevated, each null where they are counted by a later one) are added in
    place of its own. ``keep`` are columns that stay, and that the previous slices show, too.
    """
    block_seconds = width_minutes * 60 * block_slices
    volatility = F.col("stddev_battery_voltage")
    elevated = F.when(volatility > elevated_threshold, 1).otherwise(0).cast("long")
    if "carried" in slices.columns:
        volatility = F.when(F.col("carried").isNotNull(), F.col("carried.volatility")).otherwise(volatility)
        elevated = F.when(F.col("carried").isNotNull(), F.col("carried.elevated")).otherwise(elevated)
    slices = slices.withColumns(
        {
            "_block": F.floor(epoch_seconds(F.col("slice_start")) / F.lit(block_seconds)),
            "_elevated": elevated,
            "_volatility": volatility,
        }
    )
    if "slice_start" not in keep:
        slices = slices.drop("slice_start")
    return scan_blocks(
        slices, ["entity_id"], "_block", ["feature_timestamp"], values=[*HISTORY, *keep], sums=["_volatility", "_elevated"]
    )


def features_of_scan(scanned: DataFrame, minutes: float, min_records: int) -> DataFrame:
    """The features of scanned slices with at least ``min_records`` rows."""
    labels = [c for c in ("failure_type", "time_to_failure") if c in scanned.columns]

    def change(name: str) -> Column:
        return F.col(name) - F.col(f"_prev1.{name}")

    def acceleration(name: str) -> Column:
        return change(name) - (F.col(f"_prev1.{name}") - F.col(f"_prev2.{name}"))

    return scanned.filter(F.col("record_count") >= min_records).select(
        "entity_id",
        "feature_timestamp",
        *BASIC_FEATURES[:6],
        *[_zero_if_null(change(f"avg_{m}") / minutes, f"slope_{m}") for m in MEASURES],
        _rolling_mean("avg_engine_temp").alias("rolling_avg_engine_temp"),
        _rolling_mean("avg_trans_oil_pressure").alias("rolling_avg_trans_oil_pressure"),
        _zero_if_null(F.col("_run__volatility"), "cumulative_volatility"),
        _zero_if_null(F.col("_run__elevated"), "elevated_window_count"),
        _zero_if_null(change("stddev_battery_voltage"), "volatility_delta"),
        _zero_if_null(acceleration("avg_engine_temp"), "temp_acceleration"),
        _zero_if_null(acceleration("avg_trans_oil_pressure"), "pressure_acceleration"),
        *labels,
    )


def latest_per_entity(df: DataFrame, ts: str) -> DataFrame:
    """Newest row per entity; ties go to the greatest remaining columns.

    A struct maximum combines on the map side, so only one row per entity and task moves.
    """
    rest = [c for c in df.columns if c not in ("entity_id", ts)]
    return (
        df.groupBy("entity_id")
        .agg(F.max(F.struct(ts, *rest)).alias("_row"))
        .select(*[F.col("entity_id") if c == "entity_id" else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def newest_points(telemetry: DataFrame, ts: str = "ts") -> DataFrame:
    """As ``latest_per_entity``, for raw points: the newest time is a hash aggregate over two
    columns, and only the points at that time are compared as rows."""
    newest = telemetry.groupBy("entity_id").agg(F.max(ts).alias("_newest"))
    at = telemetry.join(newest.withColumnRenamed("entity_id", "_id"), F.col("entity_id").eqNullSafe(F.col("_id")) & (F.col(ts) == F.col("_newest")))
    return latest_per_entity(at.select(*telemetry.columns), ts)


def latest_features(features: DataFrame) -> DataFrame:
    """One row per entity, the newest, with its time named ``prediction_timestamp``."""
    return latest_per_entity(features, "feature_timestamp").withColumnRenamed("feature_timestamp", "prediction_timestamp")


def latest_snapshot(telemetry: DataFrame) -> DataFrame:
    """All rows at the newest timestamp of the table."""
    return telemetry.filter(F.col("ts") == telemetry.select(F.max("ts")).scalar())
