"""Helpers several text operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space all word rules here split on.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of text that a task turns into arrays at a time.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty; columns of other names cannot clash later."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fold(doc_id: Column, modulus: int) -> Column:
    """The remainder that puts a document into the training or the held-out part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % modulus


def chunks(batches: Iterator, limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of Arrow batches with columns doc_id and text, cut to about ``limit`` characters.

    Only the list of one chunk is alive at a time; a longer single text makes a chunk alone.
    """
    for batch in batches:
        ids, column = batch.column("doc_id"), batch.column("text")
        start, size = 0, 0
        lengths = _byte_lengths(column)
        for i, length in enumerate(lengths):
            size += length
            if size >= limit or i + 1 == len(lengths):
                part = slice(start, i + 1 - start)
                yield ids.slice(part.start, part.stop).to_pylist(), column.slice(part.start, part.stop).to_pylist()
                start, size = i + 1, 0


def _byte_lengths(column) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()
