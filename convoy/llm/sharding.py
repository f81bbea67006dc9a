"""Contiguous shards of near equal bytes from prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoy.settings import staged

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` runs of near equal bytes.

    Rows are ordered by (md5 of the text, id), so equal texts are neighbours and only a cut
    can part them. The order is range-partitioned; each partition's byte total is summed
    over the partitions before it, and a running sum inside the partition gives every row its
    place on the byte axis, cut at equal targets by the middle of the row. No shard is
    further from the target than the size of one row.

    A null text has no bytes (size 16) and is a neighbour of the empty ones, a null id comes
    first among equal texts, repeated rows each get a slot, an empty table gives no rows, and
    only the two named columns are read.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("content"),
    )
    ordered = staged(slim.repartitionByRange("content", "doc_id").withColumn("part", F.spark_partition_id()), "shard-order")

    # One row per partition: small whatever the number of documents.
    totals = ordered.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("total"),
    )

    here = Window.partitionBy("part").orderBy("content", "doc_id")
    running = F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        ordered.join(F.broadcast(offsets), "part")
        .withColumn("middle", 2 * (F.col("bytes_before") + running) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(here) - 1)
        .select("doc_id", "size", "text_crc32", "place", F.expr(f"middle * {int(shards)} div (2 * total)").cast("int").alias("shard"))
    )
    placed = staged(placed, "shard-place")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
