"""Failure class and time to failure from the newest features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.numeric import any_missing, clamp
from convoy.operators.features import BASIC_FEATURES, TEMPORAL_FEATURES

# Bounds of a predicted time to failure, in hours, and the model labels.
TTF_LOW, TTF_HIGH = 0.1, 24.0
TEMPORAL_MODEL, BASIC_MODEL, NO_MODEL = "temporal_16_features", "basic_11_features", "none"
BASIC_CLASSES = ["ENGINE_FAILURE", "TRANSMISSION_FAILURE"]


@dataclass(frozen=True)
class RuleThresholds:
    volatility: float = 0.95
    engine_temp: float = 55.0
    trans_pressure: float = 60.0


def rule_class(rules: RuleThresholds = RuleThresholds()) -> Column:
    return (
        F.when(any_missing(BASIC_FEATURES), "NORMAL")
        .when(F.col("stddev_battery_voltage") > rules.volatility, "ELECTRICAL_FAILURE")
        .when(F.col("avg_engine_temp") > rules.engine_temp, "ENGINE_FAILURE")
        .when(F.col("avg_trans_oil_pressure") > rules.trans_pressure, "TRANSMISSION_FAILURE")
        .otherwise("NORMAL")
    )


def guarded_ttf(raw: Column, inputs: list[str]) -> Column:
    """Clamped estimate; 0 when an input is missing."""
    return F.when(any_missing(inputs), 0.0).otherwise(clamp(raw, TTF_LOW, TTF_HIGH))


def _model_used(kind: Column) -> Column:
    return (
        F.when(kind == "ELECTRICAL_FAILURE", TEMPORAL_MODEL)
        .when(kind.isin(BASIC_CLASSES), BASIC_MODEL)
        .otherwise(NO_MODEL)
    )


def prediction_columns(kind: Column, ttf: Column) -> list[Column]:
    return [
        F.col("prediction_timestamp"),
        F.col("entity_id"),
        F.col("avg_engine_temp").alias("current_engine_temp"),
        F.col("avg_trans_oil_pressure").alias("current_trans_pressure"),
        F.col("avg_battery_voltage").alias("current_battery_voltage"),
        kind.alias("predicted_failure_type"),
        ttf.alias("predicted_hours_to_failure"),
        _model_used(kind).alias("ttf_model_used"),
    ]


def score_rules(latest: DataFrame, rules: RuleThresholds = RuleThresholds(), keep: Sequence[str] = ()) -> DataFrame:
    """Threshold rules behind the same routing as the fitted models; ``keep`` passes columns on."""
    kind = F.col("_class")
    electrical = guarded_ttf(24 - F.col("cumulative_volatility") / 2, TEMPORAL_FEATURES_AS_DOUBLE)
    basic = guarded_ttf(F.col("avg_engine_temp") / 10, BASIC_FEATURES)
    ttf = F.when(kind == "ELECTRICAL_FAILURE", electrical).when(kind.isin(BASIC_CLASSES), basic)
    return latest.withColumn("_class", rule_class(rules)).select(*prediction_columns(kind, ttf), *keep)


# The count among the temporal inputs is an integer and never missing.
TEMPORAL_FEATURES_AS_DOUBLE = [f for f in TEMPORAL_FEATURES if f != "elevated_window_count"]


def score_hybrid(latest: DataFrame, classifier, ttf_basic, ttf_temporal) -> DataFrame:
    """Classify, then run each time-to-failure model only on the rows routed to it."""
    classed = classifier.classify(latest)
    kind = F.col("predicted_failure_type")
    electrical = ttf_temporal.estimate(classed.filter(kind == "ELECTRICAL_FAILURE"))
    basic = ttf_basic.estimate(classed.filter(kind.isin(BASIC_CLASSES)))
    rest = classed.filter(kind.isNull() | ~kind.isin("ELECTRICAL_FAILURE", *BASIC_CLASSES)).withColumn(
        "predicted_ttf", F.lit(None).cast("double")
    )
    scored = electrical.unionByName(basic).unionByName(rest)
    return scored.select(*prediction_columns(kind, F.col("predicted_ttf")))


def prediction_distribution(predictions: DataFrame) -> DataFrame:
    return (
        predictions.groupBy("predicted_failure_type", "ttf_model_used")
        .agg(
            F.count(F.lit(1)).alias("prediction_count"),
            F.round(F.avg("predicted_hours_to_failure"), 2).alias("avg_ttf_hours"),
        )
        .orderBy(F.desc("prediction_count"), "predicted_failure_type")
    )
