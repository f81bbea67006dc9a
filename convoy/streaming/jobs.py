"""Structured Streaming versions of the incremental operators.

Every job runs over what its source holds and stops, to be started again on a schedule with
the same checkpoint; pass another ``trigger`` to keep it running. State is kept in hash buckets
and committed under the version of the micro-batch, so a replayed batch repeats its own write.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.timeslice import ntz
from convoy.operators.features import (
    HISTORY,
    MEASURES,
    TEMPORAL_FEATURES,
    features_of_scan,
    latest_features,
    newest_points,
    scan_slices,
    slice_aggregate,
)
from convoy.operators.state import latest_upsert, marker_maintenance, prediction_upsert
from convoy.schemas import MARKERS, PREDICTIONS
from convoy.sources.store import append_batch, drop_expired
from convoy.settings import Clock, discard, scratch_path
from convoy.sources.buckets import BUCKETS, BucketStore
from convoy.streaming.stats import SLICE_STATS, merge_stats, slice_stats, slices_of

ONCE = {"availableNow": True}
LATEST = "entity_id STRING, ts TIMESTAMP_NTZ, engine_temp DOUBLE, trans_oil_pressure DOUBLE, battery_voltage DOUBLE"


def slice_aggregate_stream(readings: DataFrame, width_minutes: int, delay: str) -> DataFrame:
    """Closed slices of a telemetry stream; rows behind the watermark are dropped.

    A watermark needs a zoned timestamp; the session zone is UTC, so values are unchanged.
    """
    zoned = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    slices = slice_aggregate(zoned, width_minutes)
    zone_free = [F.col(c).cast("timestamp_ntz").alias(c) if c in ("bucket_time", "latest_timestamp") else F.col(c) for c in slices.columns]
    return slices.select(*zone_free)


def run_slice_aggregate(
    readings: DataFrame, target: str, checkpoint: str, width_minutes: int = 5, delay: str = "1 hour", trigger: dict = ONCE
) -> None:
    query = (
        slice_aggregate_stream(readings, width_minutes, delay)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
    query.awaitTermination()


def run_append(readings: DataFrame, target: str, checkpoint: str, trigger: dict = ONCE) -> None:
    """Add arriving rows to the date-partitioned telemetry table, each exactly once."""
    query = (
        readings.withColumn("event_date", F.to_date("ts"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("event_date")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
    query.awaitTermination()


def _run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], mode: str, checkpoint: str, trigger: dict) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(step)
        .trigger(**trigger)
        .start()
    )
    query.awaitTermination()


def run_retained(readings: DataFrame, target: str, checkpoint: str, hours: int, trigger: dict = ONCE) -> None:
    """Add arriving rows to the date-partitioned table and delete the dates that have expired.

    A replayed batch replaces its own folders. Read it with ``read_retained``; the table has no log
    of a stream sink, which would go on naming deleted files.
    """

    def step(batch: DataFrame, version: int) -> None:
        append_batch(batch, target, version)
        drop_expired(batch.sparkSession, target, hours)

    _run_batches(readings, step, "append", checkpoint, trigger)


def latest_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, path, {"latest": LATEST}, buckets)


def run_latest(readings: DataFrame, store: BucketStore, checkpoint: str, trigger: dict = ONCE) -> None:
    """Newest reading per entity, kept in the table ``latest`` of a bucket store.

    A batch is reduced to one row per entity before it meets the stored rows of its buckets.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        base = store.state(below=version)
        with _working(store.spark, newest_points(batch.select("entity_id", "ts", *MEASURES)), "newest") as newest:
            touched = store.touched(newest)
            updated = latest_upsert(store.read("latest", base, touched), newest)
            store.commit(version, base, touched, {"latest": updated}, {})

    _run_batches(readings, step, "append", checkpoint, trigger)


@contextmanager
def _working(spark: SparkSession, df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The rows as a table in the shared folder, for several reads within one batch."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)


@dataclass(frozen=True)
class FeatureRule:
    """How slices become features; the batch operator's parameters."""

    width_minutes: int = 5
    min_records: int = 12
    elevated_threshold: float = 0.7
    block_slices: int = 288

    def scan(self, slices: DataFrame) -> DataFrame:
        """Slices with their history, for ``features`` and for the next carry."""
        return scan_slices(slices, self.width_minutes, self.elevated_threshold, self.block_slices, _TIMES)

    def features(self, scanned: DataFrame) -> DataFrame:
        return features_of_scan(scanned.filter("carried IS NULL"), float(self.width_minutes), self.min_records)


_TIMES = ["slice_start", "feature_timestamp"]
_SLICE = "STRUCT<" + ", ".join([*[f"{t}: TIMESTAMP_NTZ" for t in _TIMES], *[f"{h}: DOUBLE" for h in HISTORY]]) + ">"
#: What is left of an entity's closed slices, however many: the last two and the sums over all.
CARRY = f"entity_id STRING, last {_SLICE}, second {_SLICE}, volatility DOUBLE, elevated BIGINT"
FEATURES = "entity_id STRING, feature_timestamp TIMESTAMP_NTZ, " + ", ".join(
    f"{f} {'BIGINT' if f == 'elevated_window_count' else 'DOUBLE'}" for f in TEMPORAL_FEATURES
)


@dataclass
class StoredTable:
    """A table of the stream's store as of the newest commit."""

    read: Callable[[], DataFrame]


@dataclass
class PredictionStream:
    """Telemetry in; features, predictions and first-failure markers kept.

    Points are folded into statistics of the slices that are still open. A slice closes when
    the newest reading of all is ``delay_minutes`` past its end; readings that come later are
    dropped. Features of closed slices are written once and not read again: of a closed slice
    only what later ones need is carried (``CARRY``, one row per entity). So state and work of
    a batch depend on its entities and the open slices, not on the history.

    A batch rewrites the buckets of its own entities. Slices of silent entities stay stored as
    open until their entity is heard again; ``features`` shows them just the same.
    """

    spark: SparkSession
    path: str
    clock: Clock
    score: Callable[[DataFrame], DataFrame]
    rule: FeatureRule = field(default_factory=FeatureRule)
    with_predictions: bool = True
    with_markers: bool = True
    delay_minutes: int = 60
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        tables = {"open": SLICE_STATS, "carry": CARRY, "predictions": PREDICTIONS, "markers": MARKERS}
        self.store = BucketStore(self.spark, f"{self.path}/tables", tables, self.buckets)
        self.stats = StoredTable(lambda: self.store.read("open"))
        self.markers = StoredTable(lambda: self.store.read("markers"))
        self.predictions = StoredTable(self._current_predictions)

    def _current_predictions(self) -> DataFrame:
        """Every refresh holds for all entities, so its time is kept once and not in every row."""
        state = self.store.state()
        refreshed = F.lit(state.facts.get("newest")).cast("timestamp_ntz")
        return self.store.read("predictions", state).withColumn("last_updated", refreshed)

    def features(self) -> DataFrame:
        """Features of all slices, closed and open."""
        state = self.store.state()
        slices = self._with_carry(slices_of(self.store.read("open", state)), self.store.read("carry", state))
        return self.closed_features().unionByName(self.rule.features(self.rule.scan(slices)))

    def closed_features(self) -> DataFrame:
        """Features of closed slices, as the commits have appended them."""
        state = self.store.state()
        if not state.version:
            return self.spark.createDataFrame([], FEATURES)
        found = self.spark.read.schema(f"{FEATURES}, version BIGINT").parquet(f"{self.path}/features")
        return found.filter(F.col("version") <= state.version).drop("version")

    @staticmethod
    def _with_carry(slices: DataFrame, carry: DataFrame) -> DataFrame:
        """Open slices after the last two closed ones, of which the last stands for all before."""
        sums = "STRUCT<volatility: DOUBLE, elevated: BIGINT>"
        seeds = carry.select(
            "entity_id",
            F.explode(
                F.array(
                    F.struct(F.col("second").alias("s"), F.struct(F.lit(None).alias("volatility"), F.lit(None).alias("elevated")).cast(sums).alias("carried")),
                    F.struct(F.col("last").alias("s"), F.struct("volatility", "elevated").cast(sums).alias("carried")),
                )
            ).alias("_seed"),
        ).filter("_seed.s IS NOT NULL")
        seeds = seeds.select("entity_id", "_seed.s.*", "_seed.carried")
        return slices.withColumn("carried", F.lit(None).cast(sums)).unionByName(seeds, allowMissingColumns=True)

    def _next_carry(self, scanned: DataFrame, watermark: Column) -> DataFrame:
        gone = scanned.filter(F.col("carried").isNotNull() | self._closed(watermark))
        times_first = [*_TIMES, *HISTORY]
        row = F.struct(
            F.struct(*times_first).alias("last"),
            F.when(F.col("_prev1").isNotNull(), F.struct(*[F.col(f"_prev1.{c}").alias(c) for c in times_first])).alias("second"),
            F.col("_run__volatility").alias("volatility"),
            F.col("_run__elevated").alias("elevated"),
        )
        return gone.groupBy("entity_id").agg(F.max_by(row, "feature_timestamp").alias("_c")).select("entity_id", "_c.*")

    def _closed(self, watermark: Column) -> Column:
        width = F.make_dt_interval(mins=F.lit(self.rule.width_minutes))
        return F.coalesce(F.col("slice_start") + width <= watermark, F.lit(False))

    def _step(self, batch: DataFrame, batch_id: int) -> None:
        version, minutes = batch_id + 1, self.rule.width_minutes
        base = self.store.state(below=version)
        watermark = F.lit(base.facts.get("watermark")).cast("timestamp_ntz")
        stats = slice_stats(batch.select("entity_id", "ts", *MEASURES), minutes)
        with _working(self.spark, stats.filter(~self._closed(watermark)), "fresh") as fresh:
            touched = self.store.touched(fresh)
            latest = fresh.agg(F.max("feature_timestamp")).first()[0]
            known = base.facts.get("newest")
            newest = max([t for t in (latest, known and datetime.fromisoformat(known)) if t], default=None)
            if newest is None:  # nothing has been heard yet
                return
            bound = newest - timedelta(minutes=self.delay_minutes)
            facts = {"newest": newest.isoformat(sep=" "), "watermark": bound.isoformat(sep=" ")}
            merged = merge_stats(self.store.read("open", base, touched), fresh)
            slices = self._with_carry(slices_of(merged), self.store.read("carry", base, touched))
            with ExitStack() as tables:
                scanned = tables.enter_context(_working(self.spark, self.rule.scan(slices), "scanned"))
                closing = self._closed(ntz(bound))
                done = self.rule.features(scanned.filter(closing))
                done.write.mode("overwrite").parquet(f"{self.path}/features/version={version}")
                changes = {"open": merged.filter(~closing), "carry": self._next_carry(scanned, ntz(bound))}
                if self.with_predictions:
                    # New ones of the touched entities only: those of the others cannot change.
                    scored = self.score(latest_features(self.rule.features(scanned)))
                    predictions = prediction_upsert(self.store.read("predictions", base, touched), scored, newest)
                    predictions = tables.enter_context(_working(self.spark, predictions, "predicted"))
                    changes["predictions"] = predictions
                    if self.with_markers:
                        epoch = int((newest - self.clock.start).total_seconds() // self.clock.step_seconds)
                        kept = self.store.read("markers", base, touched)
                        changes["markers"] = marker_maintenance(kept, predictions, newest, epoch, minutes)
                self.store.commit(version, base, touched, changes, facts)

    def run(self, readings: DataFrame, trigger: dict = ONCE) -> None:
        _run_batches(readings, self._step, "append", f"{self.path}/checkpoint", trigger)
