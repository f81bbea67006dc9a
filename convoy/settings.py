"""Fixed values of the fleet model, the clock, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

# Changing any of these changes results.
SPEED_MPH = 55.0
STEP_SECONDS = 5
SAFETY_FACTOR = 0.85
RETENTION_HOURS = 48
EARTH_RADIUS_MILES = 3959
BREAKDOWN_HOURS = 0.5
DEFAULT_TTF_HOURS = 6.0
CLASS_LABELS = ["NORMAL", "ENGINE_FAILURE", "TRANSMISSION_FAILURE", "ELECTRICAL_FAILURE"]
OVERRIDE_TYPES = ["ENGINE", "TRANSMISSION", "ELECTRICAL"]

MILES_PER_EPOCH = SPEED_MPH * STEP_SECONDS / 3600


@dataclass(frozen=True)
class Clock:
    """Position of an epoch-indexed series on the time axis."""

    start: datetime
    next_epoch: int
    step_seconds: int = STEP_SECONDS

    def at(self, epoch: int) -> datetime:
        return self.start + timedelta(seconds=epoch * self.step_seconds)

    @property
    def recent_from(self) -> datetime:
        """Start of the two most recent steps."""
        return self.at(max(self.next_epoch - 2, 0))


def local_session(cpus: str | int = "*", app: str = "convoy") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    cores = 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder stands in only in local mode, where the one machine is the
    whole cluster; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="convoy-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written to a table in the shared folder and read back.

    Cuts lineage for good: a lost executor loses nothing, later readers prune columns, and
    their plans know the true size. ``release`` deletes the table after its last reader; what
    a result still reads is left to the cluster's policy for the folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` returned, after their last reader."""
    for table in tables:
        discard(table.sparkSession, table._staged_at)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a working table after its last reader; a missing one is fine."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
