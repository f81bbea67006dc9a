"""Exact duplicates by sorting contents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import texts
from convoy.settings import staged

#: Characters that do not count when two texts are compared.
IGNORED = " \t\n\x0b\x0c\r"
#: Leading characters of a text that a splitter may hold.
HEAD = 32


def normalised(text: Column) -> Column:
    return F.translate(text, IGNORED, "")


def _runs(batches: Iterator) -> Iterator:
    """Number the runs of equal neighbours of one sorted partition.

    Whole texts are compared, each with the one before it. Two marker rows carry the first
    and the last text of the partition, so that a run can go on in the next partition.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, run, last = TaskContext.get().partitionId(), -1, None

    def rows(ids, first, runs, chars, sha, kind, edge):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(n, part)), pa.array(runs, pa.int64()), pa.array(first, pa.bool_()), chars, sha, pa.array(np.full(n, kind), pa.int32()), edge],
            names=["doc_id", "part", "run", "first", "chars", "text_sha256", "kind", "edge"],
        )

    def marker(like, run, kind, text):
        return rows(pa.nulls(1, like["doc_id"].type), [False], [run], pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), kind, pa.array([text], pa.string()))

    for batch in batches:
        norm, n = batch.column("norm"), batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        head = norm[0].as_py()
        if last is None:
            yield marker(batch, 0, 1, head)
        new[0] = last is None or head != last
        runs = run + np.cumsum(new)
        yield rows(batch.column("doc_id"), new, runs, batch.column("chars"), batch.column("sha"), 0, pa.nulls(n, pa.string()))
        run, last, like = int(runs[-1]), norm[n - 1].as_py(), batch.slice(0, 1)
    if last is not None:
        yield marker(like, run, 2, last)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows whose texts are equal without white space, and the row of each that stays.

    The stays-first order (content, most code points, smallest id) is range-partitioned with
    sampled splitters and sorted on disk by Spark, so the copies of one text, however many,
    spread over partitions and the best one comes first. Neighbours are compared in full; runs
    that cross a partition border are joined through one row per partition. Splitters hold the
    first characters and the digest of a text, never a whole one.

    Null texts count as empty, empty texts are equal to each other, null ids come last, of
    repeated rows one stays, an empty table gives no rows, other columns are not read.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    norm = texts(docs, id_col, text_col).select(
        "doc_id", normalised(F.col("text")).alias("norm"), F.length("text").alias("chars")
    ).select("doc_id", "norm", "chars", F.sha2("norm", 256).alias("sha"), F.substring("norm", 1, HEAD).alias("head"))
    order = ["head", "sha", F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    schema = T.StructType(
        [
            T.StructField("doc_id", norm.schema["doc_id"].dataType),
            T.StructField("part", T.LongType()),
            T.StructField("run", T.LongType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("chars", T.IntegerType()),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("kind", T.IntegerType()),
            T.StructField("edge", T.StringType()),
        ]
    )
    ordered = norm.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "norm", "chars", "sha")
    found = staged(ordered.mapInArrow(_runs, schema), "content-runs")
    rows = found.filter("kind = 0").drop("kind", "edge")

    # One row per partition: which first run goes on from which earlier run.
    edges = found.filter("kind > 0").groupBy("part").agg(
        F.max(F.when(F.col("kind") == 1, F.col("edge"))).alias("head"),
        F.max(F.when(F.col("kind") == 2, F.col("edge"))).alias("tail"),
        F.max("run").alias("last_run"),
    )
    by_part = Window.orderBy("part")
    goes_on = F.coalesce(F.col("head") == F.lag("tail").over(by_part), F.lit(False))
    edges = edges.withColumn("goes_on", goes_on).withColumn(
        "source",
        F.when(F.col("last_run") > 0, F.struct("part", F.col("last_run").alias("run"))).when(
            ~F.col("goes_on"), F.struct("part", F.lit(0).cast("long").alias("run"))
        ),
    )
    earlier = F.last("source", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    joined = edges.withColumn("earlier", earlier).filter("goes_on").select(
        "part", F.lit(0).cast("long").alias("run"), F.col("earlier.part").alias("to_part"), F.col("earlier.run").alias("to_run")
    )

    runs = rows.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("first"), F.col("doc_id"))).alias("best"))
    runs = runs.join(F.broadcast(joined), ["part", "run"], "left").withColumn("goes_on", F.col("to_part").isNotNull())
    group = Window.partitionBy(F.coalesce("to_part", "part"), F.coalesce("to_run", "run"))
    runs = runs.select(
        "part",
        "run",
        "goes_on",
        F.sum("n").over(group).alias("group_size"),
        F.max(F.when(~F.col("goes_on"), F.col("best"))).over(group).alias("keep_id"),
    )
    # Keys are (partition, run), so the rows of one key are at most those of one partition.
    return rows.join(runs, ["part", "run"]).select(
        "doc_id", "keep_id", "group_size", (F.col("first") & ~F.col("goes_on")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows that stay; of rows with one id and equal texts the longest one does."""
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("_content", F.sha2(normalised(text), 256))
    rows = rows.join(kept, rows[id_col].eqNullSafe(kept["_id"]) & (rows["_content"] == kept["_sha"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_col, "_content").orderBy(F.length(text).desc(), text_col))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns)
