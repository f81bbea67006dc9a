"""Replay of a baseline series with override series spliced in per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.timeslice import ntz, plus_seconds
from convoy.operators.features import MEASURES
from convoy.settings import OVERRIDE_TYPES, Clock

FALLBACK_TYPE = "ELECTRICAL"
# Epochs of an override series that one join key stands for.
STRETCH = 1024


def _stamped(rows: DataFrame, clock: Clock, epoch: Column) -> DataFrame:
    ts = plus_seconds(ntz(clock.start), epoch * clock.step_seconds)
    return rows.select(ts.alias("ts"), "entity_id", *MEASURES)


def _first_breakdown(markers: DataFrame) -> DataFrame:
    """Entity grain: the earliest known breakdown epoch."""
    return (
        markers.filter(F.col("breakdown_epoch").isNotNull())
        .groupBy("entity_id")
        .agg(F.min("breakdown_epoch").alias("_broken"))
    )


def series_step(
    baseline: DataFrame, overrides: DataFrame, config: DataFrame, markers: DataFrame, clock: Clock, epoch: int
) -> DataFrame:
    """Rows of one epoch: override rows for entities with an active override, baseline rows
    for the others, none for entities that broke down by then.

    An active entity whose override is exhausted, or of unknown type, emits nothing.
    """
    broken = _first_breakdown(markers).filter(F.col("_broken") <= epoch).select("entity_id")
    active = (
        config.filter(F.col("enabled") & (F.col("effective_from_epoch") <= epoch))
        .join(broken, "entity_id", "left_anti")
        .select("entity_id", "failure_type", (F.coalesce("failure_next_epoch", F.lit(0)) + 1).alias("epoch"))
    )
    normal = (
        baseline.filter(F.col("epoch") == epoch)
        .join(active.select("entity_id"), "entity_id", "left_anti")
        .join(broken, "entity_id", "left_anti")
    )
    failing = active.join(overrides.filter(F.col("failure_type").isin(OVERRIDE_TYPES)), ["failure_type", "epoch"])
    at = F.lit(epoch)
    return _stamped(normal, clock, at).unionByName(_stamped(failing, clock, at))


def _spliced(config: DataFrame, overrides: DataFrame, first: Column, offset: Column, last: int) -> DataFrame:
    """Override rows per entity for target epochs ``first``..``last``.

    ``offset`` turns an override epoch into a target epoch. The override epochs an entity
    needs form one run, so it meets them by (type, stretch of ``STRETCH`` epochs) rather than
    with all rows of its type; a long backfill has many such keys.
    """
    ranged = config.withColumn("_first", first).withColumn("_offset", offset).filter(F.col("_first") <= last)
    needed = ranged.select(
        "entity_id",
        "failure_type",
        "_offset",
        "_first",
        F.explode(
            F.sequence(
                F.floor((F.col("_first") - F.col("_offset")) / STRETCH), F.floor((last - F.col("_offset")) / STRETCH)
            )
        ).alias("_stretch"),
    )
    rows = overrides.withColumn("_stretch", F.floor(F.col("epoch") / STRETCH))
    target = F.col("epoch") + F.col("_offset")
    return needed.join(rows, ["failure_type", "_stretch"]).filter(target.between(F.col("_first"), last)).withColumn(
        "_target", target
    )


def series_backfill(
    baseline: DataFrame, overrides: DataFrame, config: DataFrame, clock: Clock, epochs: int
) -> DataFrame:
    """Rows of the next ``epochs`` epochs in one job, by the batch rules.

    These differ from a repeated ``series_step``: baseline rows of an enabled entity are left
    out even before its override takes effect, broken-down entities are kept, and an unknown
    type replays the electrical override. See ``series_backfill_strict`` for the other rule.
    """
    start, last = clock.next_epoch + 1, clock.next_epoch + epochs
    enabled = config.filter("enabled")
    normal = baseline.filter(F.col("epoch").between(start, last)).join(
        enabled.select("entity_id"), "entity_id", "left_anti"
    )
    effective = F.coalesce("effective_from_epoch", F.lit(0))
    cursor = F.coalesce("failure_next_epoch", F.lit(0))
    typed = enabled.withColumn(
        "failure_type",
        F.when(F.col("failure_type").isin(OVERRIDE_TYPES), F.col("failure_type")).otherwise(FALLBACK_TYPE),
    )
    waiting = F.greatest(F.lit(0), effective - start)
    failing = _spliced(
        typed, overrides, F.greatest(effective, F.lit(start)), clock.next_epoch - cursor + waiting, last
    )
    return _stamped(normal, clock, F.col("epoch")).unionByName(_stamped(failing, clock, F.col("_target")))


def series_backfill_strict(
    baseline: DataFrame,
    overrides: DataFrame,
    config: DataFrame,
    markers: DataFrame,
    clock: Clock,
    epochs: int,
) -> DataFrame:
    """Rows of the next ``epochs`` epochs, equal to stepping through them one by one.

    Override epochs of a type are expected to be gap-free.
    """
    start, last = clock.next_epoch + 1, clock.next_epoch + epochs
    broken = _first_breakdown(markers)
    alive = F.col("_broken").isNull()
    live = config.filter(F.col("enabled") & F.col("effective_from_epoch").isNotNull())
    normal = (
        baseline.filter(F.col("epoch").between(start, last))
        .join(live.select("entity_id", F.col("effective_from_epoch").alias("_from")), "entity_id", "left")
        .filter(F.col("_from").isNull() | (F.col("epoch") < F.col("_from")))
        .join(broken, "entity_id", "left")
        .filter(alive | (F.col("epoch") < F.col("_broken")))
    )
    first = F.greatest("effective_from_epoch", F.lit(start))
    cursor = F.coalesce("failure_next_epoch", F.lit(0))
    failing = (
        _spliced(
            live.filter(F.col("failure_type").isin(OVERRIDE_TYPES)), overrides, first, first - cursor - 1, last
        )
        .join(broken, "entity_id", "left")
        .filter(alive | (F.col("_target") < F.col("_broken")))
    )
    return _stamped(normal, clock, F.col("epoch")).unionByName(_stamped(failing, clock, F.col("_target")))


def active_failures(config: DataFrame, overrides: DataFrame) -> DataFrame:
    """Progress of each enabled override of a known type through its series, which may be empty."""
    sizes = overrides.groupBy("failure_type").agg(F.count(F.lit(1)).alias("_size"))
    position, size = F.col("failure_next_epoch"), F.coalesce("_size", F.lit(0))
    return (
        config.filter(F.col("enabled") & F.col("failure_type").isin(OVERRIDE_TYPES))
        .join(sizes, "failure_type", "left")
        .select(
            "entity_id",
            "failure_type",
            "effective_from_epoch",
            position.alias("current_failure_epoch"),
            size.alias("max_epochs"),
            F.when(position > size, "OFFLINE").otherwise("ACTIVE").alias("status"),
        )
        .orderBy("entity_id")
    )
