"""Ordered scans over long series, without hot tasks.

A window partitioned by entity alone gives one task the whole history of a busy entity. Here
a series is cut into blocks (a monotone function of its order, such as the day); neighbours
and running sums are found inside each block, and only one row per block travels to the
per-entity pass that carries them over the block edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _slotted(df: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Add the (keys, block) slot. As a struct it is never null itself, so no null filter is
    inferred on one use of the rows only, and rows with a null key still meet their carry."""
    return df.withColumn("_slot", F.struct(*keys, block))


def _key_of_slot(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"_slot.{k}") for k in keys])


def _plus(run: str, base: str) -> Column:
    """Sum of two nullable parts, null when both are."""
    zero = F.lit(0)
    either = F.col(run).isNotNull() | F.col(base).isNotNull()
    return F.when(either, F.coalesce(F.col(run), zero) + F.coalesce(F.col(base), zero))


def running_sums(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Add ``_run_<s>`` for each of ``sums``: its sum per ``keys`` up to this row, nulls skipped.

    ``block`` must not decrease along ``order``. Block totals are partial aggregates, so the
    rows themselves are shuffled and sorted once.
    """
    slotted = _slotted(df, keys, block)
    upto = W.partitionBy("_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = slotted.select("*", *[F.sum(s).over(upto).alias(f"_run_{s}") for s in sums])
    totals = slotted.groupBy("_slot").agg(*[F.sum(s).alias(f"_total_{s}") for s in sums])
    before = W.partitionBy("_key").orderBy(f"_slot.{block}").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumn("_key", _key_of_slot(keys)).select(
        "_slot", *[F.sum(f"_total_{s}").over(before).alias(f"_base_{s}") for s in sums]
    )
    return local.join(carry, "_slot", "left").select(
        *df.columns, *[_plus(f"_run_{s}", f"_base_{s}").alias(f"_run_{s}") for s in sums]
    )


def scan_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    values: Sequence[str],
    sums: Sequence[str] = (),
) -> DataFrame:
    """Add the two previous rows, and running sums, per ``keys`` in ``order``.

    New columns: ``_prev1`` and ``_prev2`` (structs of ``values``, null when there is no such
    row) and ``_run_<s>`` as for ``running_sums``. ``block`` must not decrease along ``order``.
    """
    inside = W.partitionBy("_slot").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    current = F.struct(*values)
    local = _slotted(df, keys, block).select(
        "*",
        F.lag(current, 1).over(inside).alias("_prev1"),
        F.lag(current, 2).over(inside).alias("_prev2"),
        *[F.sum(s).over(upto).alias(f"_run_{s}") for s in sums],
    )
    # The last row of a block is kept with all its columns: both uses of ``local`` then need
    # the same columns, and one shuffle serves both.
    ends = (
        local.groupBy("_slot")
        .agg(F.max_by(F.struct(*[c for c in local.columns if c not in ("_slot", block)]), F.struct(*order)).alias("_end"))
        .select(
            "_slot",
            _key_of_slot(keys).alias("_key"),
            F.struct(*[F.col(f"_end.{v}") for v in values]).alias("_last"),
            F.col("_end._prev1").alias("_second"),
            *[F.col(f"_end._run_{s}").alias(f"_total_{s}") for s in sums],
        )
    )
    across = W.partitionBy("_key").orderBy(f"_slot.{block}")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(
        "_slot",
        F.lag("_last", 1).over(across).alias("_c1"),
        F.coalesce(F.lag("_second", 1).over(across), F.lag("_last", 2).over(across)).alias("_c2"),
        *[F.sum(f"_total_{s}").over(before).alias(f"_base_{s}") for s in sums],
    )
    return local.join(carry, "_slot", "left").select(
        *df.columns,
        F.coalesce("_prev1", "_c1").alias("_prev1"),
        F.coalesce("_prev2", F.when(F.col("_prev1").isNotNull(), F.col("_c1")).otherwise(F.col("_c2"))).alias("_prev2"),
        *[_plus(f"_run_{s}", f"_base_{s}").alias(f"_run_{s}") for s in sums],
    )


def balanced_width(df: DataFrame, position: Column) -> int:
    """Width of blocks along a numeric position so that rows per block and blocks balance.

    Both grow as the square root of the row count, so neither the tasks inside the blocks
    nor the pass over them holds a fixed share of the data. One pass over one column.
    """
    rows, low, high = df.agg(F.count(position), F.min(position), F.max(position)).first()
    return max(1, int((high - low + 1) / max(1.0, rows**0.5))) if rows else 1


def number_rows(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], name: str) -> DataFrame:
    """1-based position per ``keys``; ``order`` must be unique inside a key."""
    scanned = running_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, block, order, ["_one"])
    return scanned.select(*df.columns, F.col("_run__one").alias(name))
