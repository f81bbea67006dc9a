"""Tables kept on plain Parquet: versioned state and date-partitioned telemetry."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convoy.functions.timeslice import ntz


class StateTable:
    """Keyed state rewritten as a whole, one folder per version.

    A version counts once its job has committed (its success file exists), so readers never
    see half a write, and writing the same version again after a failure repeats it. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), StructType.fromDDL(schema)

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for entry in fs.listStatus(path):
            folder = entry.getPath()
            done = self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
            if folder.getName().startswith("version=") and fs.exists(done):
                found.append(int(folder.getName().split("=")[1]))
        return sorted(found)

    def read(self, below: int | None = None) -> DataFrame:
        """The newest committed state, or the newest older than version ``below``."""
        usable = [v for v in self._versions() if below is None or v < below]
        if not usable:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={usable[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        shaped = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        shaped.write.mode("overwrite").parquet(f"{self.path}/version={version}")


def append_telemetry(df: DataFrame, path: str) -> None:
    """Append rows to the telemetry table, which is partitioned by date.

    Rows are rebalanced by date: small dates share a task, and a date too big for one task is
    split over several, so files come out near the advisory size.
    """
    dated = df.withColumn("event_date", F.to_date("ts"))
    dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def read_since(spark: SparkSession, path: str, since: datetime) -> DataFrame:
    """Rows from ``since`` on; whole dates are pruned, the rest is filtered in the scan."""
    table = spark.read.parquet(path)
    kept = table.filter((F.col("event_date") >= F.lit(since.date())) & (F.col("ts") >= ntz(since)))
    return kept.drop("event_date")


def _dates(spark: SparkSession, path: str) -> list[str]:
    """Dates of the partitions, oldest first, from the names of their folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [e.getPath().getName() for e in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.split("=")[1] for n in names if n.startswith("event_date=") and not n.endswith("__"))


def newest_time(spark: SparkSession, path: str) -> datetime | None:
    """The newest time of the table: the newest date by name, then one column of that date alone."""
    for date in reversed(_dates(spark, path)):
        newest = spark.read.parquet(f"{path}/event_date={date}").agg(F.max("ts")).first()[0]
        if newest is not None:
            return newest
    return None


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Append a numbered batch; the same number again replaces what it wrote before.

    Rows without a time have no place in the table and are left out.
    """
    dated = df.filter("ts IS NOT NULL").withColumn("event_date", F.to_date("ts")).withColumn("batch", F.lit(batch))
    writer = dated.hint("rebalance", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_date", "batch").parquet(path)


def read_retained(spark: SparkSession, path: str, hours: int) -> DataFrame:
    """Rows no older than ``hours`` before the newest one; older dates are pruned. The table must hold a row."""
    return read_since(spark, path, newest_time(spark, path) - timedelta(hours=hours)).drop("batch")


def drop_expired(spark: SparkSession, path: str, hours: int) -> int:
    """Delete the date partitions that lie wholly before the retention bound."""
    newest = newest_time(spark, path)
    if newest is None:
        return 0
    bound = (newest - timedelta(hours=hours)).date().isoformat()
    old = [date for date in _dates(spark, path) if date < bound]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for date in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"event_date={date}"), True)
    return len(old)
