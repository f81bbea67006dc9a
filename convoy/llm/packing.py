"""Best-fit decreasing packing of tokenised documents into sequences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import WORD, chunks, texts
from convoy.settings import staged

END = 0
#: What the last token of a word ends with in the vocabulary.
WORD_END = "</w>"
#: Signs that are never one token with the letters before them.
SIGNS = ".,;:!?*&%$#"
#: Words a worker remembers, and the longest one it remembers.
WORDS_KEPT, LONGEST_KEPT = 1_000_000, 64
_OTHER_BLANKS = re.compile("[\x1c-\x1f]")


class CapacityTree:
    """Segment tree over remaining capacities 0..top; leaves count the open bins of a capacity."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        node = capacity + self.size
        while node:
            self.counts[node] += bins
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        node = least + self.size
        if self.counts[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.counts[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.counts[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Pieces of equal length are interchangeable, and so are bins of equal remaining capacity:
    the tightest bin takes pieces of a length until none fits, then the next one does. So
    whole runs of pieces go to whole runs of bins in one step, and the result is that of
    placing one piece at a time. Work and memory depend on ``capacity`` alone, not on the
    number of documents.

    Returns rows (length, first rank, pieces per bin, first bin, offset in the bin) sorted by
    length and rank.
    """
    tree, open_bins, plan, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, count: int) -> None:
        if count:
            open_bins[room].append((first, count))
            tree.add(room, count)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, needed = capacity, -(-left // (capacity // length))
                put(room, bins, needed)
                bins += needed
            first, count = open_bins[room].pop()
            tree.add(room, -count)
            each = room // length
            used = min(count, left // each)
            if not used:
                used, each = 1, left
            plan.append((length, rank, each, first, capacity - room))
            put(room, first + used, count - used)
            put(room - each * length, first, used)
            rank += used * each
            left -= used * each
    rows = np.array(plan, dtype=np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


@lru_cache(maxsize=2)
def _encoder(path: str):
    return WordEncoder(path)


class WordEncoder:
    """Ids of a text, piece by piece: the vocabulary drops white space and never merges across it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[number for token, number in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True

    @staticmethod
    def _pieces(text: str) -> list[str]:
        # The vocabulary lower-cases letter by letter; special tokens count as written.
        return WORD.findall(text) if "<|" in text else _split(text if "\u03a3" in text else text.lower())

    def _learn(self, new: set[str]) -> None:
        """Encode unknown pieces; letters and the signs after them are always apart.

        A run of letters is one word of the vocabulary's rules, and the last token of a word and
        no other ends it; so many such runs are encoded as one text and cut again.
        """
        cores = {piece: core for piece in new if _only_letters(core := piece.rstrip(SIGNS))}
        words = list(set(cores.values()).difference(self.known))
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends, data = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            self.known.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        tails = {piece[len(core) :] for piece, core in cores.items() if len(piece) > len(core)}
        parts = list(tails.union(new.difference(cores)).difference(self.known))
        for part, encoding in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.known[part] = np.array(encoding.ids, "<u4").tobytes()
        for piece, core in cores.items():
            if len(piece) > len(core):
                self.known[piece] = self.known[core] + self.known[piece[len(core) :]]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = list(map(self._pieces, batch))
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        encoded = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del self.known[piece]
        return encoded


def _only_letters(core: str) -> bool:
    """Whether a piece is letters still after lower-casing and composing it."""
    lower = core.lower()
    return lower.isalpha() and (lower.isascii() or unicodedata.is_normalized("NFC", lower))


def _split(text: str) -> list[str]:
    """str.split() knows more blanks than the vocabulary drops; texts with those are matched instead."""
    return text.split() if text.isascii() and not _OTHER_BLANKS.search(text) else WORD.findall(text)


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    Extra columns part and rank number the pieces of a length inside one task.
    """
    from zlib import crc32

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(c, k) for c, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType()))]
    )
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), [0] * (capacity + 1), _encoder(tokenizer_file)
        id_type, step = None, 4 * capacity
        for ids, batch in chunks(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc, data in zip(ids, encoder.encode(batch)):
                data += end
                for piece, at in enumerate(range(0, len(data), step)):
                    body = data[at : at + step]
                    length = len(body) // 4
                    for column, value in zip(out, (doc, piece, at // 4, length, crc32(body), part, seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema]
    return docs.mapInArrow(cut, schema)


def pack_best_fit(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, best-fit decreasing.

    Pieces are ranked within their length over all tasks by prefix sums of the tasks' counts.
    The driver sees the histogram of lengths only (at most ``capacity`` numbers), plans it, and
    every task turns (length, rank) into a place.

    A null text counts as empty, an empty one is the single end token, repeated rows are
    packed each, longer texts are cut into pieces, an empty table gives no rows, other columns
    are not read.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = staged(token_pieces(texts(docs, id_col, text_col), tokenizer_file, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ranks_before")).alias("rank")
    )
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = plan.value
        span = 1 << 40
        keys = rows[:, 0] * span + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            step = rows[np.searchsorted(keys, length * span + rank, side="right") - 1].reshape(-1, 5)
            nth = rank - step[:, 1]
            sequence, offset = step[:, 3] + nth // step[:, 2], step[:, 4] + nth % step[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)
