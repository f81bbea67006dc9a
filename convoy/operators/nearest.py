"""Exact nearest-point matching through grids of shrinking cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convoy.functions.geo import degree_distance_sq

# Cell sizes from coarse to fine, in degrees. The globe has 276 of the coarsest cells, and a
# cell has at most 256 of the next size inside.
LEVELS = (16.0, 1.0, 1 / 16)

# Widens the cell bound past the rounding of cell edges; candidates stay a superset.
SLACK = 1e-9


def _cell(lat: Column, lon: Column, size: float) -> Column:
    return F.struct(F.floor(lat / size).alias("y"), F.floor(lon / size).alias("x"))


def _quarter(cell: Column) -> Column:
    """Quarter of the plane, 0 to 3, that a cell is in."""
    return F.when(cell["y"] < 0, 2).otherwise(0) + F.when(cell["x"] < 0, 1).otherwise(0)


def _nearest_edge_sq(lat: Column, lon: Column, cell: Column, size: float) -> Column:
    def gap(value: Column, index: Column) -> Column:
        return F.greatest(F.lit(0.0), index * size - value, value - (index + 1) * size)

    dy, dx = gap(lat, cell["y"]), gap(lon, cell["x"])
    return dy * dy + dx * dx


def _farthest_corner_sq(lat: Column, lon: Column, cell: Column, size: float) -> Column:
    def reach(value: Column, index: Column) -> Column:
        return F.greatest(F.abs(value - index * size), F.abs(value - (index + 1) * size))

    dy, dx = reach(lat, cell["y"]), reach(lon, cell["x"])
    return dy * dy + dx * dx


def _least_reach(lat: Column, lon: Column, size: float) -> Column:
    return F.array_min(F.transform("_cells", lambda cell: _farthest_corner_sq(lat, lon, cell, size)))


def _within_reach(lat: Column, lon: Column, size: float) -> Column:
    bound = F.col("_reach") + SLACK
    return F.filter("_cells", lambda cell: _nearest_edge_sq(lat, lon, cell, size) <= bound)


def nearest(
    queries: DataFrame,
    points: DataFrame,
    key: Sequence[str],
    payload: Sequence[str],
    levels: Sequence[float] = LEVELS,
) -> DataFrame:
    """Each query row with the ``payload`` of its nearest point and ``distance_sq``.

    Queries carry ``lat``/``lon``, points ``plat``/``plon``; both carry ``key`` (may be
    empty: one common set of points). Distance is on the plane; ties go to the smallest
    payload. Queries without any point are left out.

    Points sharing a location are merged before they move. A query first meets the occupied
    cells of the coarsest grid, by its key or, without one, by quarters of the plane, and keeps
    those that can hold its nearest point; each finer grid of ``levels`` looks into the kept
    cells only. In the end a query is joined with the points of a few fine cells, not with all
    points of its key. No list is longer than the cells of one size inside one of the next
    coarser size, and of the coarsest inside a quarter of the plane (72 in degrees), whatever
    the data. A cell size must be a multiple of the next.
    """
    lat, lon = F.col("lat"), F.col("lon")
    identity = queries.columns
    located = points.filter(F.col("plat").isNotNull() & F.col("plon").isNotNull())
    cells = [_cell(F.col("plat"), F.col("plon"), size) for size in levels]
    root = located.select(*key, cells[0].alias("_cell"))
    if key:
        rows = queries.join(root.groupBy(*key).agg(F.collect_set("_cell").alias("_cells")), list(key))
    else:
        quarters = root.groupBy(_quarter(F.col("_cell")).alias("_quarter")).agg(F.collect_set("_cell").alias("_cells"))
        # Four rows at most, of as many cells as the coarsest grid has.
        rows = queries.withColumn("_quarter", F.explode(F.array(*map(F.lit, range(4))))).join(F.broadcast(quarters), "_quarter")
    same_query = W.partitionBy(*identity)
    candidates = None
    for i, size in enumerate(levels):
        if candidates is not None:
            inner = located.select(*key, cells[i - 1].alias("_cell"), cells[i].alias("_inner"))
            rows = candidates.join(
                inner.groupBy(*key, "_cell").agg(F.collect_set("_inner").alias("_cells")), [*key, "_cell"]
            )
        # Some point is no farther than the far corner of the best cell.
        rows = rows.withColumn("_reach", _least_reach(lat, lon, size))
        if candidates is not None or not key:
            rows = rows.withColumn("_reach", F.min("_reach").over(same_query))
        candidates = rows.select(*identity, F.explode(_within_reach(lat, lon, size)).alias("_cell"))
    # A single number aggregates by hashing, a struct only after a sort.
    smallest = F.struct(F.min(payload[0]).alias(payload[0])) if len(payload) == 1 else F.min(F.struct(*payload))
    places = located.groupBy(*key, "plat", "plon").agg(smallest.alias("_payload")).withColumn("_cell", cells[-1])
    distance = degree_distance_sq(lat, lon, F.col("plat"), F.col("plon"))
    return (
        candidates.join(places, [*key, "_cell"])
        .groupBy(*identity)
        .agg(F.min(F.struct(distance.alias("d"), "_payload")).alias("_best"))
        .select(
            *identity,
            *[F.col(f"_best._payload.{p}").alias(p) for p in payload],
            F.col("_best.d").alias("distance_sq"),
        )
    )
