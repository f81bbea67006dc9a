"""Repeated lines, found through levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import texts
from convoy.settings import discard, scratch_path, staged

#: Code points a key has at least, documents that hold it at least.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches a table is dealt into, runs of a level that are merged into one of the next.
BATCHES, FANOUT = 8, 4
#: At most so many keys can hold more than this share of all places.
HOT_KEYS = 256

_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_KEY = ["h1", "h2"]


def line_keys(text: str) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A to Z lower-cased, as UTF-8."""
    return [line.strip(_BLANK) for line in text.encode().translate(_LOWER).split(b"\n")]


def long_keys(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(line number, 128-bit digest) of the lines whose key has ``min_chars`` code points at least."""
    from xxhash import xxh3_128_digest

    for k, key in enumerate(line_keys(text)):
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            yield k, xxh3_128_digest(key)


def _lines(docs: DataFrame, min_chars: int, places: bool) -> DataFrame:
    """A row per long line with all columns of ``docs`` but the text; without ``places`` one per distinct key of a row."""
    carried = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*carried, T.StructField("line", T.IntegerType()), *[T.StructField(k, T.LongType()) for k in _KEY]])

    def explode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, lines, digests = [], [], []
            for row, text in enumerate(batch.column("text")):
                found = list(long_keys(text.as_py(), min_chars))
                if not places:
                    found = [(0, digest) for digest in {digest for _, digest in found}]
                rows += [row] * len(found)
                lines += [k for k, _ in found]
                digests += [digest for _, digest in found]
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            kept = [batch.column(f.name).take(pa.array(rows, pa.int64())) for f in carried]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lines, pa.int32()), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=schema.names
            )

    return docs.mapInArrow(explode, schema)


class LineRuns:
    """Levelled sorted runs of line hashes.

    A run is a table bucketed and sorted by the hash, with the rows of the batch that hold it
    (``docs``) and the largest id among them (``last``). A new batch is merged with the runs
    bucket by bucket, without a shuffle of what is stored: keys that no run holds become a run
    of level 0, the others are noted beside it. So a key is in one run only. When a level has
    ``fanout`` runs, they are merged into one run of the next level, so a key is rewritten once
    a level and a batch meets at most ``fanout - 1`` runs a level.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.again: list[str] = []
        self._paths: dict[str, str] = {}

    def store(self, rows: DataFrame, *parts: str) -> str:
        """Write rows as a bucketed and sorted table; its name."""
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = scratch_path(self.spark, "line-run")
        writer = rows.write.format("parquet").option("path", self._paths[name]).bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self._paths.pop(name))

    def run(self, name: str) -> DataFrame:
        """The keys a run holds."""
        return self.spark.table(name).filter("NOT seen").drop("seen")

    def add(self, batch: DataFrame) -> None:
        """Take in one batch of (h1, h2, docs, last) rows, one for each key."""
        known = [name for level in self.levels for name in level]
        if not known:
            batch = batch.repartition(self.buckets, *_KEY)
        for i, name in enumerate(known):
            held = self.run(name).select(*_KEY, F.lit(True).alias(f"in_{i}")).hint("merge")
            batch = batch.join(held, _KEY, "left")
        seen = F.coalesce(*[F.col(f"in_{i}") for i in range(len(known))], F.lit(False))
        name = self.store(batch.select(*_KEY, "docs", "last", seen.alias("seen")), "seen")
        self.levels[0].append(name)
        self.again.append(name)
        self._compact()

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) < self.fanout:
                return
            names, self.levels[level] = self.levels[level], []
            merged = reduce(DataFrame.unionByName, [self.run(name) for name in names])
            merged = merged.repartition(self.buckets, *_KEY).withColumn("seen", F.lit(False))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.store(merged, "seen"))
            for name in names:
                if name not in self.again:
                    self.drop(name)

    def totals(self) -> DataFrame:
        """All keys with their documents and the largest id over all batches."""
        notes = reduce(DataFrame.unionByName, [self.spark.table(name).filter("seen").drop("seen") for name in self.again])
        notes = notes.groupBy(*_KEY).agg(F.sum("docs").alias("more"), F.max("last").alias("later")).hint("merge")
        runs = [self.run(name).join(notes, _KEY, "left") for level in self.levels for name in level]
        return reduce(DataFrame.unionByName, runs).select(
            *_KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last")
        )

    def close(self) -> None:
        """Remove all tables."""
        for name in list(self._paths):
            self.drop(name)
        self.levels, self.again = [[]], []


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, docs, last) of the keys that at least ``min_docs`` rows of (doc_id, text) hold.

    All texts are read once: keys are counted for each batch before they are dealt by hash
    into the buckets of the runs, so no key sends more than a row for each task and batch.
    """
    runs = LineRuns(docs.sparkSession, fanout)
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    keys = _lines(docs.select("doc_id", "text", batch.alias("batch")), min_chars, places=False)
    counted = keys.groupBy("batch", *_KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
    arrived = runs.store(counted.repartition(runs.buckets, *_KEY), "batch")
    for i in range(batches):
        runs.add(docs.sparkSession.table(arrived).filter(F.col("batch") == i).drop("batch"))
    found = staged(runs.totals().filter(F.col("docs") >= min_docs), "frequent-lines")
    runs.close()
    return found


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Texts without the lines that many documents repeat.

    A line's key is the line without ASCII white space at its ends and with A to Z in lower
    case. Keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold lose
    all their lines except in the row with the largest id that holds them. Keys are compared
    by 128-bit hashes; their counts come from levelled sorted runs (``LineRuns``).

    The at most ``HOT_KEYS`` keys that hold more than that share of all places are broadcast,
    all others meet their lines in a join, where none of them is large. Only hashes and line
    numbers move for that; a text is shuffled once, to meet its dropped lines.

    A null text counts as empty and has one empty line; a null id counts as smaller than any
    other; rows that share the largest id all keep the line; repeated rows count as rows of
    their own; an empty table gives no rows; other columns are not read.

    Returns doc_id, text, n_lines, n_dropped.
    """
    docs = texts(docs, id_col, text_col)
    frequent = frequent_lines(docs, min_chars, min_docs, batches, fanout)
    docs = docs.withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(1), "text")})

    places = _lines(docs, min_chars, places=True)
    all_places = frequent.agg(F.sum("docs")).first()[0] or 0
    is_hot = F.col("docs") * HOT_KEYS > F.lit(all_places)
    keys = frequent.select(*_KEY, "last", is_hot.alias("hot"))
    # Fewer than HOT_KEYS keys can each hold more than this share.
    hot = F.broadcast(keys.filter("hot").withColumnRenamed("last", "hot_last"))
    split = places.join(hot, _KEY, "left")
    row = ["doc_id", "c1", "c2"]
    of_hot = split.filter("hot").select(*row, "line", F.col("hot_last").alias("last"))
    rest = split.filter("hot IS NULL").select(*row, "line", *_KEY)
    of_rest = rest.join(keys.filter("NOT hot").drop("hot"), _KEY).select(*row, "line", "last")
    dropped = of_hot.unionByName(of_rest).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    # Rows equal in id and text drop the same lines and meet as one here.
    dropped = dropped.groupBy(*row).agg(F.collect_set("line").alias("lines"))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), "lines")

    same = docs["doc_id"].eqNullSafe(dropped["_id"]) & (docs["c1"] == dropped["_c1"]) & (docs["c2"] == dropped["_c2"])
    both = docs.join(dropped, same, "left").select("doc_id", "text", "lines")
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )
    return both.mapInArrow(_without, schema)


def _without(batches: Iterator) -> Iterator:
    """Texts without the lines of the given numbers."""
    import pyarrow as pa

    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, numbers in zip(batch.column("text"), batch.column("lines")):
            lines, out = text.as_py().split("\n"), set(numbers.as_py() or ())
            n_lines.append(len(lines))
            n_dropped.append(len(out))
            kept.append("\n".join(line for k, line in enumerate(lines) if k not in out) if out else text.as_py())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=["doc_id", "text", "n_lines", "n_dropped"],
        )
