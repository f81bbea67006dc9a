from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from convoy.operators import scoring, state
from convoy.operators.features import latest_features, slice_aggregate, temporal_features
from convoy.schemas import MARKERS, PREDICTIONS
from convoy.settings import Clock
from convoy.sources.buckets import BucketStore
from convoy.streaming import jobs

SCHEMA = "entity_id string, ts timestamp_ntz, engine_temp double, trans_oil_pressure double, battery_voltage double"
START = datetime(2024, 5, 1)
RULE = jobs.FeatureRule(width_minutes=5, min_records=2, elevated_threshold=0.7, block_slices=2)


def reading(entity, minutes, temp=50.0, volt=12.0):
    return (entity, START + timedelta(minutes=minutes), temp, 30.0, volt)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder read as a stream, and a function that adds rows to it."""
    folder = str(tmp_path / "in")

    def add(data):
        frame = spark.createDataFrame(data, SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(folder)
        return spark.readStream.schema(SCHEMA).parquet(folder)

    return add


def test_slices_close_behind_the_watermark(spark, tmp_path, feed, rows):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(data):
        jobs.run_slice_aggregate(feed(data), out, checkpoint, 5, "10 minutes")
        return rows(spark.read.parquet(out), "entity_id", "bucket_time", "point_count")

    end = lambda m: START + timedelta(minutes=m)
    assert run([reading("a", 1), reading("a", 2), reading("a", 21)]) == [("a", end(5), 2)]
    # Minute 12 is late but inside the watermark (11), minute 4 is past it and dropped.
    assert run([reading("a", 12), reading("a", 4), reading("a", 30)]) == [("a", end(5), 2), ("a", end(15), 1)]
    # The slice of the newest rows stays open.
    assert run([reading("a", 31)]) == [("a", end(5), 2), ("a", end(15), 1)]


def test_closed_slices_equal_the_batch(spark, tmp_path, feed, rows):
    data = [reading("ab"[i % 2], i * 1.7, 40.0 + i) for i in range(60)]
    jobs.run_slice_aggregate(feed(data), str(tmp_path / "out"), str(tmp_path / "cp"), 5, "10 minutes")
    batch = slice_aggregate(spark.createDataFrame(data, SCHEMA), 5)
    closed = batch.filter(f"bucket_time <= TIMESTAMP_NTZ '{data[-1][1] - timedelta(minutes=10)}'")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(closed)


def test_append_adds_each_row_once(spark, tmp_path, feed, rows):
    target, checkpoint = str(tmp_path / "telemetry"), str(tmp_path / "cp")
    for data in ([reading("a", 1)], [reading("a", 2000), reading("b", 3)]):
        jobs.run_append(feed(data), target, checkpoint)
    stored = spark.read.parquet(target)
    assert rows(stored.groupBy("event_date").count().selectExpr("string(event_date)", "count")) == [("2024-05-01", 2), ("2024-05-02", 1)]


def test_latest_state_ignores_older_rows(spark, tmp_path, feed, rows):
    store = jobs.latest_store(spark, str(tmp_path / "latest"), buckets=16)
    for data in ([reading("a", 5, 1.0), reading("b", 5, 2.0)], [reading("a", 4, 3.0), reading("b", 6, 4.0), reading("c", 1, 5.0)]):
        jobs.run_latest(feed(data), store, str(tmp_path / "cp"))
    assert rows(store.read("latest"), "entity_id", "engine_temp") == [("a", 1.0), ("b", 4.0), ("c", 5.0)]
    # Only the bucket of the one entity heard is written; the others stay where they were.
    jobs.run_latest(feed([reading("b", 9, 6.0)]), store, str(tmp_path / "cp"))
    state = store.state()
    assert state.version == 3 and sorted(state.places["latest"].values()) == [2, 2, 3]
    assert len(list((tmp_path / "latest" / "latest" / "version=3").glob("_bucket=*"))) == 1
    assert rows(store.read("latest"), "entity_id", "engine_temp") == [("a", 1.0), ("b", 6.0), ("c", 5.0)]


def test_prediction_stream_equals_batch_and_survives_replay(spark, tmp_path, feed, rows):
    calm = [reading(e, m, t) for e, t in (("a", 80.0), ("b", 50.0)) for m in (0, 1, 2)]
    # A late row for a's first slice arrives with the second batch; b turns bad, a recovers.
    later = [reading("a", 3, 60.0)] + [reading("a", m, 50.0) for m in (6, 7)] + [reading("b", m, 90.0) for m in (6, 7)]
    clock = Clock(START, 0)

    def stream():
        return jobs.PredictionStream(spark, str(tmp_path / "work"), clock, scoring.score_rules, RULE)

    for data in (calm, later):
        stream().run(feed(data))
    done = stream()

    def scored(data):
        return scoring.score_rules(latest_features(temporal_features(spark.createDataFrame(data, SCHEMA), 5, 2, 0.7)))

    first_seen, second_seen = START + timedelta(minutes=2), START + timedelta(minutes=7)
    first = state.prediction_upsert(state.reset_state(spark, PREDICTIONS), scored(calm), first_seen)
    second = state.prediction_upsert(first, scored(calm + later), second_seen)
    columns = ["entity_id", "predicted_failure_type", "predicted_hours_to_failure", "last_updated"]
    assert rows(done.predictions.read(), *columns) == rows(second, *columns)
    marked = state.marker_maintenance(state.reset_state(spark, MARKERS), first, first_seen, 24)
    marked = state.marker_maintenance(marked, second, second_seen, 84)
    assert rows(done.markers.read()) == rows(marked)
    assert rows(done.features().select("entity_id", "feature_timestamp")) == [
        ("a", START + timedelta(minutes=3)), ("a", second_seen), ("b", START + timedelta(minutes=2)), ("b", second_seen),
    ]
    # The second micro-batch handed in once more writes the same versions again.
    before = rows(done.stats.read()), rows(done.markers.read())
    done._step(spark.createDataFrame(later, SCHEMA), 1)
    assert (rows(done.stats.read()), rows(done.markers.read())) == before


def trail(entity, first, last, step=1.0):
    """Readings of an entity with a measure that changes over time."""
    return [reading(entity, first + k * step, 40.0 + (first + k * step) % 7, 12.0 + ((first + k) * 13 % 5) / 4) for k in range(int((last - first) / step))]


def test_features_of_a_stream_equal_the_batch(spark, tmp_path, feed, rows):
    """Many batches, late rows, gaps, a silent entity and one without a name; closed slices are final."""

    def stream():
        return jobs.PredictionStream(spark, str(tmp_path / "work"), Clock(START, 0), scoring.score_rules, RULE, delay_minutes=10, buckets=8)

    late = [reading("a", 31.5, 99.0), reading(None, 33.2, 98.0)]
    batches = [
        trail("a", 0, 23) + trail("b", 0, 9) + trail(None, 0, 20),
        trail("a", 23, 41) + trail(None, 20, 38),
        late + trail("a", 60, 90, 0.7) + trail("c", 70, 77),
        trail("b", 90, 120) + trail("c", 110, 113),
        trail("a", 119, 131),
    ]
    for data in batches:
        stream().run(feed(data))
    done, everything = stream(), spark.createDataFrame([r for b in batches for r in b], SCHEMA)

    def rounded(df):
        return rows(df.selectExpr("entity_id", "feature_timestamp", *[f"round({c}, 6) AS {c}" for c in df.columns[2:]]))

    batch = temporal_features(everything, 5, 2, 0.7)
    assert rounded(done.features().select(*batch.columns)) == rounded(batch)
    assert done.closed_features().count() > 10
    assert done.features().schema == done.closed_features().schema
    # A reading of a closed slice comes too late and changes nothing.
    before = rounded(done.features())
    done.run(feed([reading("a", 41, 500.0)]))
    assert rounded(done.features()) == before and done.store.state().version == 6


def test_a_batch_leaves_closed_slices_and_other_buckets_alone(spark, tmp_path, feed, rows):
    stream = jobs.PredictionStream(spark, str(tmp_path / "work"), Clock(START, 0), scoring.score_rules, RULE, delay_minutes=5, buckets=32)
    names = [f"truck{i}" for i in range(12)]
    sizes = []
    for turn in range(4):
        stream.run(feed([r for n in names for r in trail(n, turn * 40, turn * 40 + 40)]))
        sizes.append([stream.store.read(t).count() for t in ("open", "carry")])
    # As much state after four times the history.
    assert sizes[0] == sizes[-1] and sizes[-1][1] == 12
    before = stream.store.state()
    stream.run(feed(trail(names[0], 160, 175)))
    after = stream.store.state()
    bucket = stream.store.touched(spark.createDataFrame([(names[0],)], "entity_id string"))
    for table in ("open", "carry", "predictions"):
        assert {b for b, v in after.places[table].items() if v == 5} == set(bucket)
        assert {b: v for b, v in after.places[table].items() if b not in bucket} == {b: v for b, v in before.places[table].items() if b not in bucket}
    # It writes the features it closes in that bucket, once, and folders of older versions go.
    closed = spark.read.parquet(str(tmp_path / "work" / "features"))
    assert stream.store.touched(closed.filter("version = 5")) == bucket
    assert closed.groupBy("entity_id", "feature_timestamp").count().filter("count > 1").isEmpty()
    kept = {int(f.parent.name.split("=")[1]) for f in (tmp_path / "work" / "tables" / "open").glob("version=*/_bucket=*")}
    assert kept == {4, 5}


def test_store_commits_all_tables_or_none(spark, tmp_path, rows):
    store = BucketStore(spark, str(tmp_path / "s"), {"x": "entity_id STRING, n BIGINT", "y": "entity_id STRING, n BIGINT"}, buckets=4)
    pair = lambda n: spark.createDataFrame([("a", n), ("b", n)], "entity_id string, n long")
    base = store.state()
    assert base.version == 0 and store.read("x").isEmpty()
    every = range(4)
    first = store.commit(1, base, every, {"x": pair(1), "y": pair(1)}, {"t": "one"})
    # A write that is not followed by its commit does not count.
    pair(7).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(tmp_path / "s" / "x" / "version=2"))
    assert rows(store.read("x")) == [("a", 1), ("b", 1)] and store.state().facts == {"t": "one"}
    store.commit(2, first, every, {"x": pair(2)}, {})
    assert (rows(store.read("x")), rows(store.read("y"))) == ([("a", 2), ("b", 2)], [("a", 1), ("b", 1)])
    # The same batch again starts from the state before; a bucket that empties is gone.
    again = store.state(below=2)
    assert again.version == 1
    store.commit(2, again, every, {"x": pair(2).filter("entity_id = 'a'")}, {})
    assert rows(store.read("x")) == [("a", 2)]
    with pytest.raises(LookupError):
        store.state(below=1)
