"""Time slices and boundary-counting differences.

Timestamps are zone-less; the session zone is expected to be UTC wherever an expression has
to pass through a zoned timestamp.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(value: datetime) -> Column:
    """Literal that folds to a constant, so comparisons with it reach the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def slice_start(ts: Column, width_seconds: int) -> Column:
    """Start of the epoch-aligned slice holding ``ts``; null stays null."""
    seconds = epoch_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(width_seconds))).cast("timestamp_ntz")


def slice_end(ts: Column, width_seconds: int) -> Column:
    """End of the slice; a timestamp on a boundary belongs to the slice it starts."""
    return plus_seconds(slice_start(ts, width_seconds), F.lit(width_seconds))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def boundaries_crossed(unit: str, start: Column, end: Column) -> Column:
    """How many ``unit`` boundaries lie between two instants (not the elapsed time)."""
    return F.timestamp_diff(unit, F.date_trunc(unit, start), F.date_trunc(unit, end))
