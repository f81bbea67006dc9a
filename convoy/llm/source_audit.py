"""How far the words of each source are from those of the other sources of its language."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoy.settings import staged

MIN_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
#: Keys of a shard (on average), keys and key bytes of the shards broadcast for one pass over the texts.
SHARD_KEYS, PASS_KEYS, PASS_BYTES = 1 << 14, 1 << 20, 1 << 25
#: Distinct words a task holds before it looks them up or sends them on, rows after which it looks how
#: many they are; slots it counts in at a time, of 32 bits, and words it counts in them at most.
HELD_WORDS, LOOK_AFTER, HELD_SLOTS, SLOT_WORDS = 200_000, 500, 1 << 25, 1 << 30
#: Cells (sources x slots) of one block of the comparison.
BLOCK_CELLS = 1 << 22
#: Places of a level of a perfect hash for each key that is left.
GAMMA = 1.6

#: Letters and all beyond ASCII are kept, A to Z lower-cased, the rest is blank.
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _hashes(terms: list[bytes], seed: int = 0) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def _shard(h: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    """The shard of a hash, from its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A new hash for each level, by multiplying and shifting."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct 64-bit numbers: (bits, level sizes, slot of each key).

    Keys that are alone at their place of a level set its bit, the others go to the next
    level; a key's slot is the number of bits set before its own.
    """
    bits, sizes, place = [], [], np.zeros(len(h), np.int64)
    left, before = np.arange(len(h)), 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = (_mix(h[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        count = np.bincount(at, minlength=size)
        alone = count[at] == 1
        place[left[alone]] = before + at[alone]
        bits.append(count == 1)
        sizes.append(size)
        left, before = left[~alone], before + size
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return flat, np.array(sizes, np.int64), np.cumsum(flat)[place] - 1


class PerfectShards:
    """Perfect hashes of some shards side by side, with the stored keys that verify a hit.

    ``rows`` are (lang, shard, shards, n, seed, bits, sizes, keys, ends) in order of language
    and shard. Slots are numbered through over the shards, so those of a language are a range.
    """

    def __init__(self, rows: list[dict]):
        import pyarrow as pa

        self.names = [(r["lang"], r["shard"]) for r in rows]
        self.first_slot = np.cumsum([0, *(r["n"] for r in rows)])
        self.at = {name: k for k, name in enumerate(self.names)}
        self.shards = {r["lang"]: r["shards"] for r in rows}
        self.seed = np.array([r["seed"] for r in rows])
        sizes = [np.frombuffer(r["sizes"], np.int64) for r in rows]
        self.sizes = np.zeros((len(rows), max(map(len, sizes))), np.int64)
        self.starts = np.zeros_like(self.sizes)
        begin = 0
        for k, size in enumerate(sizes):
            self.sizes[k, : len(size)] = size
            self.starts[k, : len(size)] = begin + np.cumsum(size) - size
            begin += size.sum()
        self.bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=size.sum()) for r, size in zip(rows, sizes)]).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.keys = pa.concat_arrays([stored_keys(r["keys"], r["ends"]) for r in rows])
        self.range: dict[str, tuple[int, int]] = {}
        for k, (lang, _) in enumerate(self.names):
            self.range[lang] = (self.range.get(lang, (int(self.first_slot[k]), 0))[0], int(self.first_slot[k + 1]))

    def slots(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """The slot of each term of a language, -1 for terms that are not kept or in other shards."""
        import pyarrow as pa
        import pyarrow.compute as pc

        h = _hashes(terms)
        shard = _shard(h, self.shards[lang])
        low = min(s for name, s in self.names if name == lang)
        held = sum(name == lang for name, _ in self.names)
        inside = (shard >= low) & (shard < low + held)
        row = np.where(inside, shard - low + self.at[lang, low], 0)
        for k in np.unique(row[self.seed[row] != 0]):
            h[row == k] = _hashes([terms[i] for i in np.flatnonzero(row == k)], int(self.seed[k]))
        slot = np.full(len(terms), -1, np.int64)
        left = np.flatnonzero(inside)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.starts[row[left], level] + (_mix(h[left], level) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at]
            slot[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        found = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[found])), pa.array([terms[i] for i in found], pa.binary()))
        slot[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return slot


def stored_keys(blob: bytes, ends: bytes):
    """The keys of a shard in the order of their slots, as an Arrow array."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.frombuffer(ends, np.int64)]).astype(np.int64)
    large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob)])
    return large.cast(pa.binary())


def _words(batches: Iterator) -> Iterator[tuple[list[tuple[str, str]], list[list[bytes]]]]:
    """(lang, source) and terms of the rows of each batch."""
    for batch in batches:
        names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        yield names, (text.as_py().encode().translate(_TERM).split() for text in batch.column("text"))


def _parted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of the terms that at least ``min_docs`` rows of a language hold, counted exactly."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, Counter] = {}

        def rows() -> Iterator:
            for lang, counts in held.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), terms, pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "docs"]
                )
            held.clear()

        for names, words in _words(batches):
            for (lang, _), terms in zip(names, words):
                held.setdefault(lang, Counter()).update(set(terms))
                if len(held[lang]) > HELD_WORDS:
                    yield from rows()
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from rows()
        yield from rows()

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, term string, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")


def _perfect_shards(kept: DataFrame, shard_keys: int) -> DataFrame:
    """A row per shard of a language's kept terms: its perfect hash and its keys in slot order."""
    shards = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_keys).cast("long").alias("shards"))

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h = _hashes([t.as_py().encode() for t in batch.column("term")])
            shard = _shard(h, batch.column("shards").to_numpy(zero_copy_only=False).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    dealt = kept.join(shards, "lang").select("lang", "term", "shards").mapInArrow(deal, "lang string, term string, shards long, shard long")

    def build(rows):
        import pyarrow as pa

        terms = sorted(t.as_py().encode() for t in rows.column("term"))
        h, seed = _hashes(terms), 0
        while len(np.unique(h)) < len(h):
            seed += 1
            h = _hashes(terms, seed)
        bits, sizes, slot = perfect_hash(h)
        ordered = [terms[i] for i in np.argsort(slot)]
        ends = np.cumsum([len(t) for t in ordered], dtype=np.int64)
        row = {
            "lang": rows.column("lang")[0].as_py(),
            "shard": rows.column("shard")[0].as_py(),
            "shards": rows.column("shards")[0].as_py(),
            "n": len(terms),
            "seed": seed,
            "bits": np.packbits(bits).tobytes(),
            "sizes": sizes.tobytes(),
            "keys": b"".join(ordered),
            "ends": ends.tobytes(),
        }
        return pa.Table.from_pylist([row])

    return dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard long, shards long, n long, seed long, bits binary, sizes binary, keys binary, ends binary"
    )


def _passes(perfect: DataFrame, pass_keys: int, pass_bytes: int) -> Iterator[tuple]:
    """First and last (lang, shard) of the shards that go to the tasks together."""
    sizes = perfect.select("lang", "shard", "n", F.length("keys").alias("bytes")).orderBy("lang", "shard")
    first = last = None
    keys = size = 0
    for r in sizes.toLocalIterator():
        if first and (keys + r["n"] > pass_keys or size + r["bytes"] > pass_bytes):
            yield first, last
            first, keys, size = None, 0, 0
        last = (r["lang"], r["shard"])
        first, keys, size = first or last, keys + r["n"], size + r["bytes"]
    if first:
        yield first, last


def _recount(docs: DataFrame, shared) -> DataFrame:
    """Occurrences of the terms of the broadcast shards in each (lang, source), as dense slots of a task."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shards: PerfectShards = shared.value
        waiting: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def look_up() -> None:
            for group, counts in waiting.items():
                slot = shards.slots(group[0], list(counts))
                n = np.fromiter(counts.values(), np.int32, len(counts))
                low, high = shards.range[group[0]]
                if group not in dense:
                    dense[group] = np.zeros(high - low, np.int32)
                dense[group][slot[slot >= 0] - low] += n[slot >= 0]
            waiting.clear()

        def rows() -> Iterator:
            for (lang, source), slots in dense.items():
                at = np.flatnonzero(slots)
                slot = at + shards.range[lang][0]
                row = np.searchsorted(shards.first_slot, slot, "right") - 1
                for part in range(0, len(at), 100_000):
                    s = slice(part, part + 100_000)
                    numbers = [[shards.names[k][1] for k in row[s]], slot[s] - shards.first_slot[row[s]], slots[at[s]]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(name, pa.string()), len(at[s])) for name in (lang, source)] + [pa.array(x, pa.int64()) for x in numbers],
                        names=["lang", "source", "shard", "slot", "n"],
                    )
            dense.clear()

        counted = 0
        for names, words in _words(batches):
            for row, (group, terms) in enumerate(zip(names, words)):
                if group[0] in shards.range:
                    waiting.setdefault(group, Counter()).update(terms)
                    counted += len(terms)
                if row % LOOK_AFTER == 0 and sum(map(len, waiting.values())) > HELD_WORDS:
                    look_up()
                    if sum(map(len, dense.values())) > HELD_SLOTS or counted > SLOT_WORDS:
                        yield from rows()
                        counted = 0
        look_up()
        yield from rows()

    return docs.mapInArrow(count, "lang string, source string, shard long, slot long, n long")


def _share(count, total, kept):
    return 1 + SCALE * (count + 1) // (total + kept)


def _compare(top: int):
    """Compare all sources of a language in one block of slots."""

    def compare(counts, context):
        import pyarrow as pa

        about = {k: v[0] for k, v in context.to_pydict().items()}
        sources, lang, v = about["sources"], about["lang"], about["kept"]
        names = [s["source"] for s in sources]
        at = {name: k for k, name in enumerate(names)}
        keys, low = stored_keys(about["keys"], about["ends"]), about["block"] * about["width"]
        c = np.zeros((len(names), min(about["width"], len(keys) - low)), np.int64)
        row = np.array([at[s] for s in counts.column("source").to_pylist()])
        c[row, counts.column("slot").to_numpy() - low] = counts.column("n").to_numpy()
        p = _share(c, np.array([[s["total"]] for s in sources]), v)
        q = _share(c.sum(axis=0), sum(s["total"] for s in sources), v)
        part, source, item, value = [], [], [], []
        for a, name in enumerate(names):
            f = (p[a] - p) ** 2 // p
            part += ["pair"] * (len(names) - 1)
            source += [name] * (len(names) - 1)
            item += names[:a] + names[a + 1 :]
            value += np.delete(f.sum(axis=1), a).tolist()
            over = np.flatnonzero((c[a] > 0) & (p[a] > q))
            f = (p[a][over] - q[over]) ** 2 // q[over]
            if len(over) > top:
                # All above the value of rank ``top``, and of those that equal it the first terms.
                least = np.partition(f, -top)[-top]
                ties = heapq.nsmallest(top - int((f > least).sum()), over[f == least], key=lambda k: keys[k + low].as_py())
                over, f = np.append(over[f > least], ties), np.append(f[f > least], [least] * len(ties))
            part += ["term"] * len(over)
            source += [name] * len(over)
            item += [keys[k + low].as_py().decode() for k in over.tolist()]
            value += f.tolist()
        columns = [pa.array([lang] * len(part), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())]
        return pa.Table.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    return compare


def source_divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    shard_keys: int = SHARD_KEYS,
    pass_keys: int = PASS_KEYS,
    pass_bytes: int = PASS_BYTES,
    block_cells: int = BLOCK_CELLS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Chi-square-like distances of each source to the other sources of its language, and its own terms.

    Terms are runs of letters with A to Z lower-cased; a language keeps the V terms of at least
    ``min_docs`` of its rows, counted exactly in a first pass. The kept terms are dealt into
    shards, each a minimal perfect hash with its keys. The second pass over the texts looks
    words up in the broadcast shards, verifies them by the stored keys and counts in dense
    slots for each (lang, source); shards beyond ``pass_keys`` or ``pass_bytes`` go in further
    passes, so a broadcast is bounded (by one shard more). With N of a group the sum of its
    counts, a term's share is p = 1 + 10^9 (count + 1) div (N + V), and
    f = (p - q)^2 div q in whole numbers.

    ``pair`` rows: f summed over all kept terms, q of the other source, 0 if nothing is kept.
    ``term`` rows: terms that a source has with p above its language's q, the ``top`` by f.
    Sources of a language are compared in blocks of slots with at most about ``block_cells``
    cells; blocks add up.

    Null text, language and source count as empty; a group without terms, a language with one
    source and a language that keeps nothing are defined by the formulas; repeated rows count
    as rows of their own; an empty table gives no rows; other columns are not read.

    Returns lang, source, part, item, value, rank.
    """
    docs = _parted(docs, lang_col, source_col, text_col)
    spark = docs.sparkSession
    kept = staged(kept_terms(docs, min_docs), "audit-terms")
    perfect = staged(_perfect_shards(kept, shard_keys), "audit-shards")

    counts = spark.createDataFrame([], "lang string, source string, shard long, slot long, n long")
    for low, high in _passes(perfect, pass_keys, pass_bytes):
        name = F.struct("lang", "shard")
        bounds = [F.struct(F.lit(lang).alias("lang"), F.lit(shard).cast("long").alias("shard")) for lang, shard in (low, high)]
        rows = perfect.filter((name >= bounds[0]) & (name <= bounds[1])).orderBy("lang", "shard").toArrow().to_pylist()
        shared = spark.sparkContext.broadcast(PerfectShards(rows))
        counted = _recount(docs, shared).groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(staged(counted, "audit-counts"))
        shared.destroy()

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = staged(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "audit-groups")

    # One row per language, with all its sources: the pairs that are asked for are their square.
    langs = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang")
    width = F.greatest(F.lit(1), F.floor(F.lit(block_cells) / F.size("sources"))).cast("long")
    langs = staged(langs.withColumn("width", width), "audit-languages")
    shards = perfect.select("lang", "shard", "n", "keys", "ends").join(langs, "lang")
    context = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("width")))))
    widths = langs.select("lang", F.col("width").alias("block_width"))
    blocks = counts.join(widths, "lang").withColumn("block", F.floor(F.col("slot") / F.col("block_width"))).drop("block_width")
    key = ["lang", "shard", "block"]
    compared = blocks.groupBy(*key).cogroup(context.groupBy(*key)).applyInArrow(
        _compare(top), "lang string, source string, part string, item string, value long"
    )
    compared = staged(compared, "audit-blocks")

    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> item")
    sums = compared.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    first = compared.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)
