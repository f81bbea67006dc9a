import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from convoy.functions.numeric import strict_greatest
from convoy.schemas import FAILURE_CONFIG, MARKERS, SERVICE_CENTERS
from convoy.settings import scratch_path, shared_dir, staged
from convoy.sources.csv import load_table, read_csv
from convoy.sources.records import json_records
from convoy.sources.store import StateTable, append_batch, append_telemetry, drop_expired, newest_time, read_retained, read_since

SCHEMA = "id BIGINT, name STRING, level DOUBLE, seen TIMESTAMP_NTZ"


def written(folder, text, name="t.csv"):
    target = folder / name
    if name.endswith(".gz"):
        with gzip.open(target, "wt") as out:
            out.write(text)
    else:
        target.write_text(text)
    return str(target)


def test_every_null_marker(spark, tmp_path, rows):
    text = '"NAME","ID","Level","SEEN"\n"",1,"\\N",\\N\n\\\\N,2,,"""\\N"""\n"a, ""b""",3,1.5,"2026-04-05 10:35:00.250"\n'
    found = rows(read_csv(spark, written(tmp_path, text), SCHEMA))
    assert sorted(found) == sorted(
        [(1, None, None, None), (2, None, None, None), (3, 'a, "b"', 1.5, datetime(2026, 4, 5, 10, 35, 0, 250000))],
        key=lambda r: r[0],
    )


def test_embedded_array_and_boolean(spark, tmp_path):
    head = '"CENTER_ID","NAME","CITY","STATE_CODE","LATITUDE","LONGITUDE","CAPABILITIES","AVAILABLE_BAYS","NODE_ID"\n'
    row = '1,"Shop","Town","AZ",33.4,-112.0,"[""ENGINE"",""BRAKES""]",6,"T"\n'
    center = read_csv(spark, written(tmp_path, head + row), SERVICE_CENTERS).first()
    assert center.capabilities == ["ENGINE", "BRAKES"] and center.available_bays == 6
    config = 'ENTITY_ID,FAILURE_TYPE,ENABLED,EFFECTIVE_FROM_EPOCH,FAILURE_NEXT_EPOCH,CREATED_AT\n"a","ENGINE",true,5,7,"\\N"\n'
    assert tuple(read_csv(spark, written(tmp_path, config, "c.csv"), FAILURE_CONFIG).first()) == ("a", "ENGINE", True, 5, 7)


@pytest.mark.parametrize("body", ["1,a,2.0\n", "1,a,2.0,,9\n", "x,a,2.0,\n", "1,a,2.0,soon\n"])
def test_bad_rows_fail_the_load(spark, tmp_path, body):
    source = written(tmp_path, "id,name,level,seen\n1,a,1.0,\n" + body)
    with pytest.raises(Exception):
        read_csv(spark, source, SCHEMA).collect()
    with pytest.raises(Exception):
        load_table(spark, source, SCHEMA, str(tmp_path / "out"))


def test_missing_column_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="level, seen"):
        read_csv(spark, written(tmp_path, "ID,NAME\n1,a\n"), SCHEMA)


def test_folder_of_gzip_parts_overwrites(spark, tmp_path, rows):
    source = tmp_path / "parts"
    source.mkdir()
    for i in range(3):
        written(source, f"id,name,level,seen\n{i},n,0.5,\n", f"p{i}.csv.gz")
    target = str(tmp_path / "table")
    for _ in range(2):
        table = load_table(spark, str(source), SCHEMA, target, partitions=2)
    assert rows(table, "id") == [(0,), (1,), (2,)]


def test_json_records(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, 7, 179575), float("nan"), float("-inf"), 1.5, None)], "e string, ts timestamp_ntz, x double, y double, z double, s string")
    text = json_records(df).first().record
    assert json.loads(text) == {"e": "a", "ts": "2024-01-01T00:00:07.179", "x": None, "y": None, "z": 1.5, "s": None}


def test_greatest_with_null_is_null(spark):
    found = spark.range(1).select(strict_greatest(F.lit(1), F.lit(None).cast("int")).alias("n"), strict_greatest(F.lit(1), F.lit(2)).alias("v")).first()
    assert (found.n, found.v) == (None, 2)


def test_state_versions(spark, tmp_path, rows):
    table = StateTable(spark, str(tmp_path / "state"), MARKERS)
    assert table.read().isEmpty()

    def state(epoch):
        at = datetime(2024, 1, 1)
        return spark.createDataFrame([("a", at, "X", at, epoch)], MARKERS)

    table.write(state(1), 1)
    table.write(state(2), 2)
    table.write(state(3), 2)  # the same batch again
    assert rows(table.read(), "breakdown_epoch") == [(3,)]
    assert rows(table.read(below=2), "breakdown_epoch") == [(1,)]
    (tmp_path / "state" / "version=2" / "_SUCCESS").unlink()
    assert rows(table.read(), "breakdown_epoch") == [(1,)]


def test_telemetry_table_prunes_and_expires_dates(spark, tmp_path, rows):
    path = str(tmp_path / "telemetry")
    days = spark.createDataFrame([("a", datetime(2024, 1, d, 12), float(d)) for d in range(1, 7)], "entity_id string, ts timestamp_ntz, engine_temp double")
    append_telemetry(days.filter("engine_temp < 4"), path)
    append_telemetry(days.filter("engine_temp >= 4"), path)
    since = read_since(spark, path, datetime(2024, 1, 5, 6))
    assert rows(since, "engine_temp") == [(5.0,), (6.0,)]
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(ts," in plan
    assert drop_expired(spark, path, 48) == 3
    assert rows(spark.read.parquet(path), "engine_temp") == [(4.0,), (5.0,), (6.0,)]


def test_a_batch_again_replaces_itself_and_old_dates_go(spark, tmp_path, rows):
    path = str(tmp_path / "retained")
    assert newest_time(spark, path) is None and drop_expired(spark, path, 48) == 0
    days = spark.createDataFrame(
        [("a", datetime(2024, 1, d, 12), float(d)) for d in range(1, 7)] + [("a", None, 9.0)], "entity_id string, ts timestamp_ntz, engine_temp double"
    )
    append_batch(days.filter("engine_temp < 5"), path, 0)
    append_batch(days.filter("engine_temp >= 5"), path, 1)
    append_batch(days.filter("engine_temp >= 5"), path, 1)  # the same batch again
    assert newest_time(spark, path) == datetime(2024, 1, 6, 12)
    kept = read_retained(spark, path, 48)
    assert kept.columns == days.columns
    assert rows(kept, "engine_temp") == [(4.0,), (5.0,), (6.0,)]
    assert drop_expired(spark, path, 48) == 3
    assert rows(read_retained(spark, path, 48), "engine_temp") == [(4.0,), (5.0,), (6.0,)]


def test_staged_rows_come_back_from_a_fresh_folder(spark, rows):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert rows(staged(spark.range(3).toDF("id"), "ids")) == [(0,), (1,), (2,)]
