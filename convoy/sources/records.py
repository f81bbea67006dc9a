"""Rows as JSON objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions.numeric import sanitize_nonfinite

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row: ISO timestamps, explicit nulls, no NaN or infinity."""
    options = {"timestampNTZFormat": ISO_MILLIS, "timestampFormat": ISO_MILLIS, "ignoreNullFields": "false"}
    return sanitize_nonfinite(df).select(F.to_json(F.struct("*"), options).alias("record"))
