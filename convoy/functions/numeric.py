"""Null- and NaN-aware numeric expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_or_null(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def sanitize_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select([finite_or_null(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def any_missing(names: Iterable[str]) -> Column:
    """True when a named double is null or NaN."""
    return reduce(lambda a, b: a | b, [F.col(n).isNull() | F.isnan(n) for n in names])


def strict_greatest(*values: Column) -> Column:
    """Greatest that is null as soon as one argument is."""
    missing = reduce(lambda a, b: a | b, [v.isNull() for v in values])
    return F.when(~missing, F.greatest(*values))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
