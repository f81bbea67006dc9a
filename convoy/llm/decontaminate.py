"""Benchmark passages in documents: CGK embedding, bit sampling, exact edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import chunks, texts

#: Share of a passage's words that must survive.
SIMILARITY = 0.8
#: Repetitions, symbols sampled in each, and steps of the walk they are sampled from.
REPETITIONS, SAMPLED, STEPS = 6, 7, 20
#: Benchmark items that one pass over the documents searches for.
ITEMS_PER_PASS = 2_000
#: Word hashes a worker remembers.
WORDS_KEPT = 300_000

_WORD = re.compile(r"[^\W_]+")


class _WordHash(dict):
    """Hashes of the words in a piece of text without blanks, as bytes."""

    def __missing__(self, piece: str) -> bytes:
        import xxhash

        # Most pieces are letters and a sign, which the pattern would find alike.
        low = piece.rstrip(".,;:!?").lower()
        words = (low,) if low.isalpha() else _WORD.findall(piece.lower())
        value = b"".join(xxhash.xxh3_64_intdigest(word).to_bytes(8, "little") for word in words)
        if len(self) < WORDS_KEPT and len(piece) < 64:
            self[piece] = value
        return value


def word_hashes(text: str, known: _WordHash) -> np.ndarray:
    return np.frombuffer(b"".join(map(known.__getitem__, text.split())), np.uint64)


def edit_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Fewest word edits that turn the item into some part of the region."""
    j = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (region != word))
        best[0] = i
        row = np.minimum.accumulate(best - j) + j
    return int(row.min())


@dataclass
class _Rule:
    """One repetition: the seed of its walk and the steps whose symbols are sampled."""

    seed: int
    steps: list[int]

    def advance(self, symbols: np.ndarray, step: int) -> np.ndarray:
        """Whether the walk moves on after showing these symbols at this step."""
        mixed = (symbols ^ np.uint64(self.seed)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(40 + step % 24)) & np.uint64(1)).astype(np.int64)

    @staticmethod
    def joined(key: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = (key ^ symbols) * np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(29))


def _rules(steps: int) -> list[_Rule]:
    """Every repetition samples the first word and random later steps, so that one look at the
    first word sorts out most windows for all of them."""
    rng = np.random.default_rng(1009 + steps)
    count = min(SAMPLED, steps) - 1
    return [_Rule(int(rng.integers(1, 2**62)), [0, *sorted((1 + rng.choice(steps - 1, count, replace=False)).tolist())] if count else [0]) for _ in range(REPETITIONS)]


def walk_length(words: int) -> int:
    """Steps for items of so many words: a walk never reads past an item that it starts."""
    return min(STEPS, 1 << (words.bit_length() - 1))


class PassageIndex:
    """Sampled keys of the embeddings of all windows of all items of one pass.

    The embedding of a window walks over its words: at each step it shows the word it stands
    on and moves on if a random bit of (word, step) says so, so an insertion or deletion is
    caught up with and edit distance becomes Hamming distance. A repetition samples some
    steps. Windows start at every word of an item, so edits spoil some of them only.
    """

    def __init__(self, items: list[tuple[object, np.ndarray]], similarity: float):
        self.items = [(i, words) for i, words in items if len(words)]
        self.limit = [int((1 - similarity) * len(words) + 1e-9) for _, words in self.items]
        self.tables = []
        by_steps: dict[int, list[int]] = {}
        for at, (_, words) in enumerate(self.items):
            by_steps.setdefault(walk_length(len(words)), []).append(at)
        for steps, members in sorted(by_steps.items()):
            flat = np.concatenate([self.items[at][1] for at in members])
            item = np.concatenate([np.full(len(self.items[at][1]), at) for at in members])
            offset = np.concatenate([np.arange(len(self.items[at][1])) for at in members])
            length = np.array([len(self.items[at][1]) for at in members]).repeat([len(self.items[at][1]) for at in members])
            padded = np.concatenate((flat, np.zeros(steps + 1, np.uint64)))
            first = None
            for rule in _rules(steps):
                at, filters, key, position = np.arange(len(flat)), [], np.zeros(len(flat), np.uint64), 0
                for step in range(rule.steps[-1] + 1):
                    symbols = padded[at]
                    if step in rule.steps:
                        key = rule.joined(key, symbols)
                        inside = at - np.arange(len(flat)) + offset < length
                        if step or first is None:
                            filters.append(self._filter(key[inside]))
                        first = filters[0] if first is None else first
                        if not step:
                            filters = [first]
                    at = at + rule.advance(symbols, step)
                order = np.argsort(key[inside], kind="stable")
                self.tables.append((rule, filters, key[inside][order], item[inside][order], offset[inside][order]))

    @staticmethod
    def _filter(keys: np.ndarray) -> np.ndarray:
        size = 1 << max(12, (16 * len(keys)).bit_length())
        seen = np.zeros(size, bool)
        seen[(keys & np.uint64(size - 1)).astype(np.int64)] = True
        return seen

    def candidates(self, flat: np.ndarray) -> np.ndarray:
        """Rows (window start, item, offset in the item) whose sampled embeddings agree."""
        padded, found = np.concatenate((flat, np.zeros(STEPS + 1, np.uint64))), []
        first, opened = _Rule.joined(np.zeros(len(flat), np.uint64), flat), {}
        for rule, filters, keys, item, offset in self.tables:
            # Repetitions for items of one size look for the same first words.
            if id(filters[0]) not in opened:
                alive = np.flatnonzero(filters[0][(first & np.uint64(len(filters[0]) - 1)).astype(np.int64)])
                opened[id(filters[0])] = alive, first[alive]
            start, key = opened[id(filters[0])]
            at, seen = start, 1
            for step in range(rule.steps[-1] + 1):
                symbols = padded[at]
                if step and step in rule.steps:
                    key = rule.joined(key, symbols)
                    known = filters[seen]
                    seen += 1
                    alive = np.flatnonzero(known[(key & np.uint64(len(known) - 1)).astype(np.int64)])
                    start, at, key, symbols = start[alive], at[alive], key[alive], symbols[alive]
                at = at + rule.advance(symbols, step)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hits = high - low
            if hits.any():
                which = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
                found.append(np.stack((np.repeat(start, hits), item[which], offset[which]), axis=1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def search(self, batch: list[str], known: _WordHash) -> list[tuple[int, int, int]]:
        """(text number, item number, distance) of the items that a text holds, each once."""
        words = [word_hashes(t, known) for t in batch]
        ends = np.cumsum([len(w) for w in words])
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        rows = self.candidates(flat)
        if not len(rows):
            return []
        doc = np.searchsorted(ends, rows[:, 0], side="right")
        # Candidates of nearly one diagonal are one alignment; its region covers them all.
        limits = np.array(self.limit)[rows[:, 1]]
        diagonal = rows[:, 0] - rows[:, 2]
        cells = np.unique(np.stack((doc, rows[:, 1], diagonal // (limits + 1)), axis=1), axis=0)
        best: dict[tuple[int, int], int] = {}
        for d, item, cell in cells.tolist():
            target, k = self.items[item][1], self.limit[item]
            if (d, item) not in best:
                # Words the text lacks altogether cost an edit each.
                lacking = len(target) - np.count_nonzero(np.isin(target, words[d]))
                best[d, item] = k + 1 if lacking <= k else -1
            if best[d, item] < 1:
                continue
            low, begin = cell * (k + 1), int(ends[d]) - len(words[d])
            region = flat[max(begin, low - k) : max(begin, min(int(ends[d]), low + len(target) + 3 * k + 1))]
            if np.count_nonzero(np.isin(target, region)) >= len(target) - k:
                best[d, item] = min(best[d, item], edit_distance(target, region))
        return [(d, item, x) for (d, item), x in sorted(best.items()) if 0 <= x <= self.limit[item]]


def passage_indexes(benchmark: DataFrame, similarity: float, items_per_pass: int = ITEMS_PER_PASS) -> Iterator[PassageIndex]:
    """Indexes of all items, at most about ``items_per_pass`` in each; items without words match nothing."""
    items = texts(benchmark, "item_id", "text").select(F.col("doc_id").alias("item_id"), "text")
    passes = -(-items.count() // items_per_pass)
    known = _WordHash()
    for i in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        yield PassageIndex([(r["item_id"], word_hashes(r["text"], known)) for r in rows], similarity)


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item it holds with at most (1 - similarity) word edits.

    Words are runs of letters and digits without case. Every window of every document is
    embedded step by step and dropped as soon as its sampled symbols fit no item; the
    windows left are verified by edit distance. The benchmark is searched in passes of
    bounded size, each sent to the tasks.

    Null and empty texts hold nothing, empty items match nothing, repeated rows give a pair
    each, repeated items one pair for each row of the benchmark, an empty table gives no rows;
    other columns are not read.

    Returns doc_id, item_id, distance, item_words, similarity.
    """
    docs = texts(docs, id_col, text_col)
    item_type = benchmark.schema["item_id"].dataType
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("item_id", item_type), T.StructField("distance", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("similarity", T.DoubleType())]
    )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema]
    found = docs.sparkSession.createDataFrame([], schema)
    for index in passage_indexes(benchmark, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            known, items = _WordHash(), shared.value.items
            for ids, batch in chunks(batches):
                hits = shared.value.search(batch, known)
                columns = (
                    [ids[d] for d, _, _ in hits],
                    [items[i][0] for _, i, _ in hits],
                    [x for _, _, x in hits],
                    [len(items[i][1]) for _, i, _ in hits],
                    [1 - x / len(items[i][1]) for _, i, x in hits],
                )
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=schema.names)

        found = found.unionByName(docs.mapInArrow(find, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """The whole rows whose text holds no benchmark item; null and empty texts stay."""
    for index in passage_indexes(benchmark, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            known = _WordHash()
            for batch in batches:
                for at in range(0, batch.num_rows, 300):
                    part = batch.slice(at, 300)
                    clean = np.ones(part.num_rows, bool)
                    for d, _, _ in shared.value.search([t or "" for t in part.column(text_col).to_pylist()], known):
                        clean[d] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
