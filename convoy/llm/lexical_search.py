"""Ranked lexical search by scanning documents with an automaton of all item terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import chunks, texts
from convoy.settings import staged

TOP = 50
#: What one automaton holds at most: items, and UTF-8 bytes of distinct terms (one item more at most).
ITEMS_PER_PASS, BYTES_PER_PASS = 10_000, 1 << 20
#: Scores (documents x items) worked out at a time; candidates kept before they are cut to the best.
CELLS, CANDIDATES = 1 << 20, 200_000
#: Parts the best rows of one item are ranked in before they meet.
SALTS = 32

#: Letters and digits and all beyond ASCII are kept, A to Z lower-cased, the rest is blank.
_TERM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Rows of the count of documents with terms and of all terms, beside the terms' own.
_DOCS, _ALL = -1, -2


def terms(text: str) -> list[bytes]:
    """Maximal runs of letters and digits, A to Z lower-cased, as UTF-8."""
    return text.encode().translate(_TERM).split()


class ItemTerms:
    """The distinct terms of some items in a boundary-guarded automaton, and the items of each.

    A term is stored with a blank on both sides and a text is scanned as its terms between
    single blanks, so the automaton finds whole terms only.
    """

    def __init__(self, items: list[tuple[object, set[bytes]]]):
        import ahocorasick

        self.ids = [item for item, _ in items]
        holders: dict[bytes, list[int]] = {}
        for k, (_, held) in enumerate(items):
            for term in held:
                holders.setdefault(term, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(holders):
            self.automaton.add_word(f" {term.decode()} ", number)
        if holders:
            self.automaton.make_automaton()
        self.n_terms = len(holders)
        self.first = np.cumsum([0, *map(len, holders.values())])
        self.items = np.array([k for held in holders.values() for k in held], np.int64)

    def count(self, text: str) -> tuple[int, Counter]:
        """All terms of a text, and how often it holds each term of the items."""
        found = terms(text)
        if not found or not self.n_terms:
            return len(found), Counter()
        guarded = f" {b' '.join(found).decode()} "
        return len(found), Counter([number for _, number in self.automaton.iter(guarded)])


def item_passes(benchmark: DataFrame, items_per_pass: int, bytes_per_pass: int) -> Iterator[ItemTerms]:
    """Automata of all items; the driver reads the items one by one and holds those of one pass."""
    items, seen, size = [], set(), 0
    for row in texts(benchmark, "item_id", "text").toLocalIterator():
        held = set(terms(row["text"]))
        items.append((row["doc_id"], held))
        size += sum(len(term) for term in held - seen)
        seen |= held
        if len(items) >= items_per_pass or size >= bytes_per_pass:
            yield ItemTerms(items)
            items, seen, size = [], set(), 0
    if items:
        yield ItemTerms(items)


def _document_counts(docs: DataFrame, shared) -> dict[int, int]:
    """Documents that hold each term, documents with any term, and all terms with repeats."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.zeros(shared.value.n_terms, np.int64)
        with_terms = total = 0
        for _, part in chunks(batches):
            for text in part:
                n, found = shared.value.count(text)
                with_terms += n > 0
                total += n
                held[list(found)] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, [_DOCS, _ALL])), pa.array(np.append(held[at], [with_terms, total]))], names=["term", "n"]
        )

    counted = docs.mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}  # at most the terms of one pass


class _Best:
    """The highest-scoring rows of each item, equal scores by ascending id, rows without an id last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.rows, self.waiting = [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.rows.append((item, scores[doc, item], missing[doc], ids[doc]))
        self.waiting += len(doc)
        if self.waiting > CANDIDATES:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*self.rows)]
        item, score, missing, ids = columns
        order = np.lexsort((ids, missing, -score, item))
        nth = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[nth == self.top - 1]
        self.least[item[last]] = score[last]
        self.rows = [tuple(c[order[nth < self.top]] for c in columns)]
        self.waiting = 0
        return self.rows[0]


def _scores(index: ItemTerms, weight: np.ndarray, docs: list[tuple[int, Counter]], n_docs: int, n_all: int) -> np.ndarray:
    """Scores of documents (rows) for items (columns), in whole numbers."""
    scores = np.zeros((len(docs), len(index.ids)), np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(found) for _, found in docs])
    if not len(doc):
        return scores
    term = np.fromiter((t for _, found in docs for t in found), np.int64, len(doc))
    tf = np.fromiter((x for _, found in docs for x in found.values()), np.int64, len(doc))
    m = np.array([50 + 50 * n * n_docs // n_all for n, _ in docs], np.int64)[doc]
    gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
    # Every (document, term) meets the items of the term.
    width = index.first[term + 1] - index.first[term]
    start = np.cumsum(width) - width
    place = np.arange(width.sum()) - np.repeat(start - index.first[term], width)
    np.add.at(scores, (np.repeat(doc, width), index.items[place]), np.repeat(gain, width))
    return scores


def ranked_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    top: int = TOP,
    items_per_pass: int = ITEMS_PER_PASS,
    bytes_per_pass: int = BYTES_PER_PASS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``top`` documents of each benchmark item by a length-normalised sum of term weights.

    Texts are scanned with an automaton of all item terms: once for the document counts the
    weights need, once for the scores. Nothing is kept of a document but its place among the
    best of an item, so what a task sends is ``top`` rows an item at most, ranked in
    ``SALTS`` parts before they meet. Beyond one automaton's bound the items go in passes.
    All arithmetic but the logarithm is in whole numbers; ids are whole numbers.

    Null and empty texts hold no terms and count nowhere, items without terms have no rows,
    repeated documents get a place each, a repeated item has a list for each of its rows
    (numbered by ``item``), a null id comes last among equal scores, an empty table gives no
    rows; other columns are not read.

    Returns item_id, rank, doc_id, score, item.
    """
    docs = texts(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType
    if not isinstance(id_type, T.IntegralType):
        raise TypeError(f"{id_col} has to be a whole number, not {id_type.simpleString()}")
    schema = T.StructType(
        [T.StructField("item", T.LongType()), T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]
    )
    spark = docs.sparkSession
    best, before = spark.createDataFrame([], schema), 0
    for index in item_passes(benchmark, items_per_pass, bytes_per_pass):
        shared = spark.sparkContext.broadcast(index)
        counts = _document_counts(docs, shared)
        n_docs, n_all = counts.pop(_DOCS, 0), counts.pop(_ALL, 0)
        weight = np.zeros(index.n_terms, np.int64)
        for term, df in counts.items():
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        found = docs.mapInArrow(_best_of_task(shared, weight, n_docs, n_all, top, before, schema), schema)
        best = best.unionByName(staged(found, "lexical-search"))
        shared.destroy()
        before += len(index.ids)

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", F.col("doc_id").cast(id_type).alias("doc_id"), "score", "item")


def _best_of_task(shared, weight: np.ndarray, n_docs: int, n_all: int, top: int, before: int, schema: T.StructType):
    """A function from texts to the best rows of each item among them."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        index = shared.value
        best = _Best(len(index.ids), top)
        rows = max(1, CELLS // len(index.ids))
        for ids, part in chunks(batches):
            for at in range(0, len(ids), rows):
                found = [index.count(text) for text in part[at : at + rows]]
                some = ids[at : at + rows]
                missing = np.array([i is None for i in some])
                best.add(_scores(index, weight, found, n_docs, n_all), np.array([i or 0 for i in some], np.int64), missing)
        if not best.rows:
            return
        item, score, missing, kept = best.cut()
        for at in range(0, len(item), 10_000):
            s = slice(at, at + 10_000)
            columns = [
                pa.array(item[s] + before),
                pa.array([index.ids[k] for k in item[s]], to_arrow_type(schema["item_id"].dataType)),
                pa.array(kept[s], mask=missing[s]),
                pa.array(score[s]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return scan
