"""CSV loads that fail on bad rows and know the null markers of exported tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

# Texts that mean null.
NULL_MARKERS = ["", r"\N", r"\\N", r'"\N"']


def read_csv(spark: SparkSession, path: str, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """Typed rows of a CSV file or folder (plain or gzip) with a header.

    Columns are matched to ``schema`` by name without regard to case, others are ignored and
    missing ones are an error. A row of the wrong width, or text that does not fit its type,
    fails the load. All files must share one header. ``partitions`` spreads the rows of
    unsplittable gzip files.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    raw = (
        spark.read.schema(StructType([StructField(c, StringType()) for c in header]))
        .options(header=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False, columnPruning=False)
        .csv(path)
    )
    if partitions:
        raw = raw.repartition(partitions)
    by_name = {c.strip().lower(): c for c in header}
    missing = [f.name for f in fields if f.name.lower() not in by_name]
    if missing:
        raise ValueError(f"no such column in {path}: {', '.join(missing)}")
    return raw.select(
        [_typed(F.col(f"`{by_name[f.name.lower()]}`"), f.dataType).alias(f.name) for f in fields]
    )


def _typed(text: Column, kind: DataType) -> Column:
    value = F.when(~text.isin(NULL_MARKERS), text)
    if isinstance(kind, (ArrayType, StructType)):
        return F.from_json(value, kind)
    return value.cast(kind)


def load_table(spark: SparkSession, source: str, schema: StructType | str, target: str, partitions: int | None = None) -> DataFrame:
    """Replace a Parquet table by the rows of a CSV source."""
    read_csv(spark, source, schema, partitions).write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)
