import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from convoy.functions.timeslice import boundaries_crossed, slice_end, slice_start
from convoy.operators.blocks import number_rows, running_sums, scan_blocks
from convoy.operators.features import latest_features, latest_snapshot, slice_aggregate, temporal_features
from convoy.streaming.stats import merge_stats, slice_stats, slices_of

SCHEMA = "entity_id string, ts timestamp_ntz, engine_temp double, trans_oil_pressure double, battery_voltage double"
START = datetime(2024, 5, 1)


def readings(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def random_readings(seed, entities=("A", "B"), slices=40):
    """Uneven slices with gaps, some of a single row."""
    rnd = random.Random(seed)
    data = []
    for entity in entities:
        for i in range(slices):
            if rnd.random() < 0.2:
                continue
            for _ in range(rnd.choice([1, 2, 5])):
                ts = START + timedelta(seconds=300 * i + rnd.uniform(0, 299))
                data.append((entity, ts, rnd.uniform(150, 230), rnd.uniform(20, 60), rnd.uniform(11, 14)))
    return data


def expected_features(data, min_records, threshold):
    """The 16 features by plain loops over one entity after the other."""
    found = {}
    for entity in {d[0] for d in data}:
        slices = {}
        for _, ts, *measures in (d for d in data if d[0] == entity):
            slices.setdefault(int((ts - START).total_seconds() // 300), []).append((ts, *measures))
        history, volatility, elevated = [], 0.0, 0
        for key in sorted(slices):
            points = slices[key]
            avg = [statistics.fmean(p[i] for p in points) for i in (1, 2, 3)]
            sd = [statistics.stdev([p[i] for p in points]) if len(points) > 1 else None for i in (1, 2, 3)]
            volatility += sd[2] or 0.0
            elevated += int(sd[2] is not None and sd[2] > threshold)
            p1 = history[-1] if history else None
            p2 = history[-2] if len(history) > 1 else None
            last3 = [h[0] for h in history[-2:]] + [avg]
            if len(points) >= min_records:
                found[entity, max(p[0] for p in points)] = [
                    *avg, sd[2], sd[0], sd[1],
                    *[(avg[i] - p1[0][i]) / 5 if p1 else 0.0 for i in range(3)],
                    statistics.fmean(a[0] for a in last3), statistics.fmean(a[1] for a in last3),
                    volatility, elevated,
                    sd[2] - p1[1] if p1 and sd[2] is not None and p1[1] is not None else 0.0,
                    *[(avg[i] - p1[0][i]) - (p1[0][i] - p2[0][i]) if p2 else 0.0 for i in range(2)],
                ]
            history.append((avg, sd[2]))
    return found


@pytest.mark.parametrize("block_slices", [1, 2, 7, 288])
def test_features_match_loops_for_any_block_size(spark, block_slices):
    data = random_readings(5)
    result = temporal_features(readings(spark, data), min_records=2, elevated_threshold=0.7, block_slices=block_slices)
    expected = expected_features(data, 2, 0.7)
    got = {(r[0], r[1]): list(r[2:]) for r in result.collect()}
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


def test_sparse_slice_counts_as_history_but_is_not_returned(spark, at):
    data = [("A", at(0, 0, s), 100.0 + s, 1.0, 12.0) for s in (0, 1)]
    data += [("A", at(0, 5), 200.0, 1.0, 12.0)]
    data += [("A", at(0, 30, s), 300.0, 1.0, 12.0) for s in (0, 1)]
    found = temporal_features(readings(spark, data), min_records=2).orderBy("feature_timestamp").collect()
    assert [r.feature_timestamp for r in found] == [at(0, 0, 1), at(0, 30, 1)]
    # The previous slice is the sparse one, several slices back, and the divisor stays 5.
    assert found[1].slope_engine_temp == (300.0 - 200.0) / 5
    assert found[1].temp_acceleration == (300.0 - 200.0) - (200.0 - 100.5)
    assert found[1].rolling_avg_engine_temp == pytest.approx((100.5 + 200 + 300) / 3)
    assert found[1].volatility_delta == 0.0


def test_boundary_belongs_to_the_slice_it_starts(spark, at, rows):
    data = [("A", at(0, 4, 59), 1.0, 1.0, 1.0), ("A", at(0, 5, 0), 3.0, 1.0, 1.0)]
    found = rows(slice_aggregate(readings(spark, data)), "bucket_time", "avg_engine_temp", "point_count")
    assert found == [(at(0, 5), 1.0, 1), (at(0, 10), 3.0, 1)]


def test_all_null_measure_and_exact_threshold(spark, at):
    # Two voltages 0.7*sqrt(2) apart have a sample deviation of 0.7: not above the threshold.
    pair = [12.0, 12.0 + 0.7 * 2**0.5]
    exact = pair[0] + (pair[1] - pair[0])
    data = [("A", at(0, 0, i), None, 1.0, v) for i, v in enumerate([12.0, exact])]
    row = temporal_features(readings(spark, data), min_records=2, elevated_threshold=0.7000001).first()
    assert row.avg_engine_temp is None and row.rolling_avg_engine_temp is None and row.slope_engine_temp == 0
    assert row.elevated_window_count == 0


def test_null_entity_keeps_its_history(spark, at):
    data = [(None, at(0, m), float(m), 1.0, 12.0) for m in (0, 5, 10)]
    found = temporal_features(readings(spark, data), min_records=1, block_slices=1).orderBy("feature_timestamp").collect()
    assert [r.slope_engine_temp for r in found] == [0.0, 1.0, 1.0]


def test_row_order_and_partitioning_do_not_matter(spark, rows):
    data = random_readings(9, slices=20)
    one = temporal_features(readings(spark, data).coalesce(1), min_records=1)
    many = temporal_features(readings(spark, data).orderBy(F.rand(3)).repartition(7), min_records=1)
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes]
    assert rows(one.select(rounded)) == rows(many.select(rounded))


def test_labels_take_the_lexicographic_maximum(spark, at, rows):
    data = [
        ("A", at(0, 0, 0), "NORMAL", 4.0), ("A", at(0, 0, 1), "ENGINE_FAILURE", 2.0),
        ("A", at(0, 5, 0), "NORMAL", 4.0), ("A", at(0, 5, 1), "TRANSMISSION_FAILURE", 1.0),
    ]
    df = spark.createDataFrame(data, "entity_id string, ts timestamp_ntz, failure_type string, time_to_failure double")
    full = df.selectExpr("*", "1D engine_temp", "1D trans_oil_pressure", "12D battery_voltage")
    found = rows(temporal_features(full, min_records=2, label="max"), "failure_type", "time_to_failure")
    assert found == [("NORMAL", 3.0), ("TRANSMISSION_FAILURE", 2.5)]
    more = full.unionByName(full.filter("failure_type = 'ENGINE_FAILURE'"))
    assert rows(temporal_features(more, min_records=3, label="mode"), "failure_type") == [("ENGINE_FAILURE",)]


def test_latest_rows(spark, at, rows):
    data = [("A", at(1), 1.0, 1.0, 1.0), ("A", at(2), 2.0, 1.0, 1.0), ("B", at(2), 3.0, 1.0, 1.0), ("C", at(0), 4.0, 1.0, 1.0)]
    features = temporal_features(readings(spark, data), min_records=1)
    assert rows(latest_features(features), "entity_id", "prediction_timestamp") == [("A", at(2)), ("B", at(2)), ("C", at(0))]
    assert rows(latest_snapshot(readings(spark, data)), "entity_id") == [("A",), ("B",)]


def test_differences_count_boundaries(spark, at):
    df = spark.createDataFrame([(at(0, 0, 59), at(0, 1, 0)), (at(0, 0, 0), at(0, 0, 59))], "a timestamp_ntz, b timestamp_ntz")
    found = df.select(boundaries_crossed("MINUTE", F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in found] == [1, 0]
    ends = df.select(slice_start(F.col("b"), 300).alias("s"), slice_end(F.col("b"), 300).alias("e")).first()
    assert (ends.s, ends.e) == (at(0, 0), at(0, 5))


def test_scan_blocks_finds_neighbours_over_empty_blocks(spark):
    data = [("k", b, o) for b, o in [(0, 1), (3, 2), (3, 3), (9, 4)]]
    df = spark.createDataFrame(data, "k string, b int, o int")
    found = scan_blocks(df, ["k"], "b", ["o"], ["o"], ["o"]).orderBy("o").collect()
    assert [(r.o, r._prev1 and r._prev1.o, r._prev2 and r._prev2.o, r._run_o) for r in found] == [
        (1, None, None, 1), (2, 1, None, 3), (3, 2, 1, 6), (4, 3, 2, 10),
    ]


def test_running_sums_carry_over_blocks_and_null_keys(spark):
    data = [(k, b, o, v) for k in ("k", None) for b, o, v in [(0, 1, None), (3, 2, 5), (3, 3, None), (9, 4, 7)]]
    df = spark.createDataFrame(data, "k string, b int, o int, v int")
    found = running_sums(df, ["k"], "b", ["o"], ["v"]).orderBy("k", "o").collect()
    assert [r._run_v for r in found] == [None, 5, 5, 12] * 2


def test_number_rows_per_key(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id", "id div 50 AS b")
    numbered = number_rows(df, ["k"], "b", ["id"], "n")
    numbered.collect()
    assert numbered.filter(F.col("n") == F.floor(F.col("id") / 3) + 1).count() == 1000


def test_merged_statistics_equal_those_of_all_rows(spark, rows):
    data = random_readings(21, slices=15)
    whole = slices_of(slice_stats(readings(spark, data), 5))
    parts = [slice_stats(readings(spark, data[i::3]), 5) for i in range(3)]
    merged = slices_of(merge_stats(merge_stats(parts[0], parts[1]), parts[2]))
    rounded = [F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in whole.dtypes]
    assert rows(merged.select(rounded)) == rows(whole.select(rounded))
