"""Mergeable slice statistics: what a stream keeps instead of its points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators.features import MEASURES

SLICE_STATS = (
    "entity_id STRING, slice_start TIMESTAMP_NTZ, feature_timestamp TIMESTAMP_NTZ, record_count BIGINT, "
    + ", ".join(f"n_{m} BIGINT, mean_{m} DOUBLE, m2_{m} DOUBLE" for m in MEASURES)
)
_KEYS = ["entity_id", "slice_start"]


def slice_stats(telemetry: DataFrame, width_minutes: int) -> DataFrame:
    """Count, mean and sum of squared deviations per entity, slice and measure."""
    measured = []
    for m in MEASURES:
        n = F.count(m)
        measured += [n.alias(f"n_{m}"), F.avg(m).alias(f"mean_{m}"), (F.var_pop(m) * n).alias(f"m2_{m}")]
    return (
        telemetry.groupBy("entity_id", F.window("ts", f"{width_minutes} minutes").alias("slice"))
        .agg(F.max("ts").alias("feature_timestamp"), F.count(F.lit(1)).alias("record_count"), *measured)
        .withColumn("slice_start", F.col("slice.start"))
        .drop("slice")
    )


def merge_stats(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Statistics over the rows of both sides, by the pairwise update of mean and deviation."""
    a, b = kept.alias("a"), fresh.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in _KEYS], "full_outer")

    def count(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(0))

    columns = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in _KEYS]
    columns.append(F.greatest("a.feature_timestamp", "b.feature_timestamp").alias("feature_timestamp"))
    columns.append((count("a", "record_count") + count("b", "record_count")).alias("record_count"))
    for m in MEASURES:
        na, nb = count("a", f"n_{m}"), count("b", f"n_{m}")
        total = na + nb
        gap = F.col(f"b.mean_{m}") - F.col(f"a.mean_{m}")
        only = F.coalesce(f"a.mean_{m}", f"b.mean_{m}")
        both = (na > 0) & (nb > 0)
        columns += [
            total.alias(f"n_{m}"),
            F.when(both, F.col(f"a.mean_{m}") + gap * nb / total).otherwise(only).alias(f"mean_{m}"),
            F.when(both, F.col(f"a.m2_{m}") + F.col(f"b.m2_{m}") + gap * gap * na * nb / total)
            .otherwise(F.coalesce(f"a.m2_{m}", f"b.m2_{m}"))
            .alias(f"m2_{m}"),
        ]
    return joined.select(*columns)


def slices_of(stats: DataFrame) -> DataFrame:
    """Slice averages and deviations in the shape the feature step reads."""
    def deviation(m: str) -> Column:
        n = F.col(f"n_{m}")
        return F.when(n > 1, F.sqrt(F.col(f"m2_{m}") / (n - 1)))

    return stats.select(
        "entity_id",
        "slice_start",
        "feature_timestamp",
        *[F.col(f"mean_{m}").alias(f"avg_{m}") for m in MEASURES],
        *[deviation(m).alias(f"stddev_{m}") for m in MEASURES],
        "record_count",
    )
