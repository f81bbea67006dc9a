"""Shortest paths over a road network and the detour table built on them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.operators.routes import hop_points, line_points, path_hops
from convoy.settings import SPEED_MPH, discard, scratch_path, staged

PATH_SEPARATOR = ">"
#: Tables of one level of the log that are merged into one of the next.
MERGED = 8


def shortest_paths(adjacency: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest route from every source to every node it can reach.

    ``adjacency`` (from_node, to_node, miles) with ``miles >= 0``; ``sources`` (node_id).
    Returns source, target, distance_miles, path (array of nodes); a source reaches itself
    at 0. Among equally long routes the path that sorts first wins; for that order a label
    holds its path and not only the node before.

    All sources advance together. A round joins the labels improved in the last one with the
    edges and writes two tables of that size: the labels reached, and those of them that are
    better than what the log of all improvements holds for the same keys. The log is read, not
    rewritten: its tables are merged ``MERGED`` at a time into the next level, so a label is
    written again once a level. Every round is staged in the shared folder, so a lost executor
    costs no finished round and the plan does not grow.
    """
    spark = adjacency.sparkSession
    roads = staged(
        adjacency.filter((F.col("miles") >= 0) & (F.col("from_node") != F.col("to_node")))
        .groupBy("from_node", "to_node")
        .agg(F.min("miles").alias("miles")),
        "roads",
    )
    start = sources.select(F.col("node_id").alias("source")).distinct().select(
        "source",
        F.col("source").alias("target"),
        F.struct(F.lit(0.0).alias("distance"), F.array("source").alias("path")).alias("label"),
    )
    log = _Log(spark, _write(start, "frontier"))
    for _ in count():  # ends with the first round that improves nothing
        frontier = log.newest()
        if frontier.isEmpty():
            return log.best().select(
                "source", "target", F.col("label.distance").alias("distance_miles"), F.col("label.path").alias("path")
            )
        reached = (
            frontier.join(roads, F.col("target") == F.col("from_node"))
            .filter(~F.array_contains("label.path", F.col("to_node")))
            .groupBy("source", F.col("to_node").alias("target"))
            .agg(
                F.min(
                    F.struct(
                        (F.col("label.distance") + F.col("miles")).alias("distance"),
                        F.concat("label.path", F.array("to_node")).alias("path"),
                    )
                ).alias("label")
            )
        )
        path = _write(reached, "reached")
        reached = spark.read.schema(frontier.schema).parquet(path)
        known = log.rows().join(reached.select("source", "target"), ["source", "target"], "left_semi")
        # An equal label that is known wins, so only improved ones form the next frontier.
        rivals = known.withColumn("new", F.lit(1)).unionByName(reached.withColumn("new", F.lit(2)))
        best = rivals.groupBy("source", "target").agg(F.min(F.struct("label", "new")).alias("best"))
        log.add(_write(best.filter("best.new = 2").select("source", "target", "best.label"), "frontier"))
        discard(spark, path)


def _write(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


class _Log:
    """Improved labels, a table for each round, merged by levels."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.schema = spark, spark.read.parquet(path).schema
        self.levels: list[list[str]] = [[path]]
        self.last = path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def newest(self) -> DataFrame:
        return self._read([self.last])

    def rows(self) -> DataFrame:
        return self._read([path for level in self.levels for path in level])

    @staticmethod
    def _best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "target").agg(F.min("label").alias("label"))

    def best(self) -> DataFrame:
        """The best label of each source and target."""
        return self._best(self.rows())

    def add(self, path: str) -> None:
        gone, self.last = self.last, path
        if not any(gone in level for level in self.levels):
            discard(self.spark, gone)  # it was the frontier still when it had been merged
        self.levels[0].append(path)
        for i in range(len(self.levels)):
            if len(self.levels[i]) < MERGED:
                break
            full, self.levels[i] = self.levels[i], []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(_write(self._best(self._read(full)), "labels"))
            for old in full:
                if old != self.last:
                    discard(self.spark, old)


def rejected_edges(adjacency: DataFrame) -> DataFrame:
    """Edges the search leaves out: null or negative miles."""
    return adjacency.filter(F.col("miles").isNull() | (F.col("miles") < 0))


def path_text(path: str = "path"):
    return F.array_join(path, PATH_SEPARATOR)


def detour_table(paths: DataFrame, centers: DataFrame) -> DataFrame:
    """Distance, driving time and path from each source node to each service center."""
    return paths.join(
        centers.select("center_id", F.col("node_id").alias("target")), "target"
    ).select(
        F.col("source").alias("from_node_id"),
        F.col("center_id").alias("to_center_id"),
        F.col("target").alias("to_center_node_id"),
        "distance_miles",
        (F.col("distance_miles") / SPEED_MPH).alias("duration_hours"),
        path_text().alias("path_nodes"),
    )


def path_geometry(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Road points along each shortest path: from_node_id, to_node_id, pos, lon, lat."""
    keys = ["from_node_id", "to_node_id"]
    visited = paths.select(
        F.col("source").alias("from_node_id"),
        F.col("target").alias("to_node_id"),
        F.posexplode("path").alias("sequence_num", "node_id"),
    )
    return line_points(hop_points(path_hops(visited, keys), edges, keys), keys)


def detour_candidates(detours: DataFrame, centers: DataFrame) -> DataFrame:
    """Detours with the facts of their centers, nearest first."""
    facts = centers.select(
        F.col("center_id").alias("to_center_id"),
        "name",
        "city",
        "state_code",
        F.col("latitude").alias("sc_lat"),
        F.col("longitude").alias("sc_lng"),
    )
    return (
        detours.filter(F.col("distance_miles") >= 0)
        .join(facts, "to_center_id")
        .orderBy("distance_miles", "from_node_id", "to_center_id")
    )
