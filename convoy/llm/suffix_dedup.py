"""Repeated passages by induced sorting of sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import texts
from convoy.settings import staged

#: Bytes of a passage, and of the grams that sample suffixes.
LENGTH, GRAM = 100, 24
#: Grams in a passage, and passage starts that one half of them handles.
WINDOW = LENGTH - GRAM + 1
HALF = (WINDOW + 1) // 2
#: Suffix tuples sorted in one group by a task; a larger group is settled by keyed minima.
GROUP = 20_000
#: Bytes (P1) or tuples (P2) that a task turns into arrays at a time.
TILE, TUPLES = 1 << 20, 40_000

# The base of the rolling sums (odd), its inverse is derived; the mixer's multipliers.
BASE = 0x9E3779B97F4A7C15 | 1
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_PLACE = 15  # bits below the start of a place: 7 for hi - lo, 8 for anchor - lo
_TAG = 47  # bits below the tag of the text, 15 bits beside the 64 of its doc


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = np.uint64(base)
        return np.multiply.accumulate(out)

    return table(BASE), table(pow(BASE, -1, 1 << 64))


class _Sums:
    """Rolling sums of a byte array: a 64-bit hash of any range of it."""

    def __init__(self, data: np.ndarray):
        size = max(1 << 21, 1 << int(len(data) + 1).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def sampled_suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Suffixes that sample every passage of texts laid end to end at [starts, ends).

    Of the grams of each passage the one of the smallest hash is its anchor, the leftmost at
    ties; equal passages so have equal anchors at equal offsets. Passages that follow one
    another and have one anchor are one tuple.

    Returns arrays (text, lo, hi, anchor, gram hash, span hash): first and last start of the
    passages, and the hash of all bytes they cover.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = _Sums(data)
    first = np.arange(len(data) - GRAM + 1)
    grams = _mixed((sums.sums[GRAM:] - sums.sums[: len(first)]) * sums.inverse[: len(first)] + np.uint64(GRAM))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | first.astype(np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)

    inside = np.zeros(len(anchor) + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(valid):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = anchor[valid]
    text = np.searchsorted(starts, valid, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1) | (text[1:] != text[:-1]))))
    lo, hi = valid[new], valid[np.concatenate((new[1:], [len(valid)])) - 1]
    anchor = anchor[new]
    # The anchor's place in the span is part of the span's hash.
    span = sums.hashes(lo, hi + LENGTH) + _mixed((anchor - lo).astype(np.uint64) + np.uint64(1))
    return text[new], lo, hi, anchor, grams[anchor], span


def induced_repeats(key: np.ndarray, order: np.ndarray, left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray):
    """(row, step) of passages that a row with the same key and smaller ``order`` also holds.

    Row i stands for a suffix: ``right[i]`` are its first bytes (LENGTH at most), ``left[i]``
    the bytes before it, nearest first. The suffixes are sorted once with the common prefixes
    of neighbours. Then the order of the suffixes that start one byte earlier is induced: a
    stable sort by the byte put in front, with a common prefix one longer than the least
    between the two rows before, and so on to the left. Rows that share LENGTH bytes are equal
    passages, and all but the first of them are repeats.
    """
    n = len(key)
    rows = np.lexsort((*(right[:, c] for c in range(right.shape[1] - 1, -1, -1)), key))
    equal = (right[rows[1:]] == right[rows[:-1]]) & (np.arange(right.shape[1]) < np.minimum(right_size[rows[1:]], right_size[rows[:-1]])[:, None])
    common = np.zeros(n, np.int64)
    common[1:] = np.where(equal.all(axis=1), right.shape[1], equal.argmin(axis=1)) * (key[rows[1:]] == key[rows[:-1]])
    found_rows, found_steps = [], []
    for step in range(left.shape[1] + 1):
        if step:
            alive = np.flatnonzero(left_size[rows] >= step)
            if not len(alive):
                break
            byte = left[rows[alive], step - 1]
            by = alive[np.lexsort((byte, key[rows[alive]]))]
            same = (key[rows[by[1:]]] == key[rows[by[:-1]]]) & (left[rows[by[1:]], step - 1] == left[rows[by[:-1]], step - 1])
            longer = np.zeros(len(by), np.int64)
            pairs = np.flatnonzero(same)
            if len(pairs):
                cuts = np.stack((by[pairs] + 1, by[pairs + 1] + 1), axis=1).ravel()
                least = np.minimum.reduceat(np.append(common, 0), cuts)[::2]
                longer[pairs + 1] = least + 1
            rows, common = rows[by], longer
        group = np.cumsum(common < LENGTH)
        if group[-1] == len(group):
            continue
        best = np.lexsort((order[rows], group))
        repeat = np.concatenate(([False], group[best][1:] == group[best][:-1]))
        found_rows.append(rows[best[repeat]])
        found_steps.append(np.full(int(repeat.sum()), step))
    if not found_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_rows), np.concatenate(found_steps)


def _pack(tag: int, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (np.int64(tag) << _TAG) | (lo << _PLACE) | ((hi - lo) << 8) | (anchor - lo)


def _unpack(place: np.ndarray):
    lo = (place >> _PLACE) & ((1 << (_TAG - _PLACE)) - 1)
    return lo, lo + ((place >> 8) & 127), lo + (place & 255)


def _suffix_tuples(batches: Iterator) -> Iterator:
    """P1: the sampled suffixes (gram, span, ord, doc, place) of every text, in tiles of bounded size."""
    import pyarrow as pa

    def flush(pieces):
        data = np.frombuffer(b"".join(p[4] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[4]) for p in pieces])
        starts = ends - [len(p[4]) for p in pieces]
        text, lo, hi, anchor, gram, span = sampled_suffixes(data, starts, ends)
        order, doc, tag, begin = (np.array([p[k] for p in pieces], np.int64)[text] for k in range(4))
        shift = begin - starts[text]
        place = _pack(0, lo + shift, hi + shift, anchor + shift) | (tag << _TAG)
        columns = (gram.view(np.int64), span.view(np.int64), order, doc, place)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "span", "ord", "doc", "place"])

    pieces, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for order, doc, tag, text in zip(*(part.column(c).to_pylist() for c in ("ord", "doc", "tag", "bytes"))):
                for start in range(0, max(len(text) - LENGTH + 1, 0), TILE):
                    piece = text[start : start + TILE + LENGTH - 1]
                    pieces.append((order, doc, tag, start, piece))
                    size += len(piece)
                    if size >= TILE:
                        yield flush(pieces)
                        pieces, size = [], 0
    if pieces:
        yield flush(pieces)


def _settle_spans(batches: Iterator) -> Iterator:
    """Sorted tuples (gram, span, ord, doc, place): whole spans seen before, and those that need their bytes.

    kind 0: the same span came earlier, all its passages are repeats. kind 1: the first of a
    span whose gram also has another span. What another partition might hold counts as needed.
    """
    import pyarrow as pa

    def rows(kind, *columns):
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.full(len(columns[0]), kind), pa.int32())], names=["gram", "ord", "doc", "place", "kind"])

    last, waiting, follows = None, None, True
    for batch in batches:
        gram, span, order, doc, place = (batch.column(c).to_numpy() for c in ("gram", "span", "ord", "doc", "place"))
        if not len(gram):
            continue
        head = np.concatenate(([last is None or (gram[0], span[0]) != last[:2]], (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])))
        # Rows equal in id and text are one document: a tuple just like the one before is the same passage.
        moved = np.concatenate(([last is None or (order[0], doc[0], place[0]) != last[2:]], (order[1:] != order[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))
        seen = ~head & moved
        if seen.any():
            yield rows(0, gram[seen], order[seen], doc[seen], place[seen])
        heads = np.flatnonzero(head)
        g, o, d, p = gram[heads], order[heads], doc[heads], place[heads]
        if waiting is not None:
            g, o, d, p = (np.append(w, x) for w, x in zip(waiting, (g, o, d, p)))
        last = (gram[-1], span[-1], order[-1], doc[-1], place[-1])
        if not len(g):
            continue
        # ``follows``: the gram of the first head is (or, first of all, might be) that of the one before.
        near = g[1:] == g[:-1]
        need = np.concatenate(([follows], near))[:-1] | near
        if need.any():
            yield rows(1, g[:-1][need], o[:-1][need], d[:-1][need], p[:-1][need])
        follows, waiting = bool(near[-1]) if len(near) else follows, (g[-1:], o[-1:], d[-1:], p[-1:])
    if waiting is not None:
        yield rows(1, *waiting)


def _contexts(batches: Iterator) -> Iterator:
    """P2: for each needed tuple, the suffix tuples (key, ord, doc, base, left, right) of its two halves.

    The near half holds the passages that start at most HALF - 1 bytes before the anchor, all of
    them hold the bytes hashed into its key; the far half holds the rest.
    """
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 50):
            part = batch.slice(at, 50)
            out: list[list] = [[], [], [], [], [], []]
            for order, doc, tag, packed, places in zip(*(part.column(c).to_pylist() for c in ("ord", "doc", "tag", "z", "places"))):
                text = unpack.decompress(packed)
                place = np.array(places, np.int64)
                lo, hi, anchor = _unpack(place)
                good = hi + LENGTH <= len(text)
                lo, hi, anchor = lo[good], hi[good], anchor[good]
                for depth, top, common in ((0, HALF - 1, (0, LENGTH - HALF + 1)), (HALF, WINDOW - 1, (-HALF, LENGTH - WINDOW + 1))):
                    base = anchor - depth
                    nearest, furthest = np.maximum(anchor - hi, depth), np.minimum(anchor - lo, top)
                    for b, a, h, far, ok in zip(base.tolist(), anchor.tolist(), hi.tolist(), furthest.tolist(), (nearest <= furthest).tolist()):
                        if ok:
                            out[0].append(_key(text[a + common[0] : a + common[1]], depth))
                            out[1].append(order)
                            out[2].append(doc)
                            out[3].append((tag << _TAG) | b)
                            out[4].append(text[a - far : b])
                            out[5].append(text[b : min(b + LENGTH, h + LENGTH)])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["key", "ord", "doc", "base", "left", "right"])


def _key(data: bytes, depth: int) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(data, seed=depth)
    return value - (1 << 64) if value >= 1 << 63 else value


def _settle_passages(batches: Iterator) -> Iterator:
    """Sorted tuples of P2 to repeats (kind 0: ord, doc, start), or to single passages with their digest (kind 1).

    Groups that lie whole in the partition and hold at most GROUP tuples are sorted here. The
    passages of other groups are settled by keyed minima later.
    """
    import pyarrow as pa
    import xxhash

    names = ["ord", "doc", "start", "kind", "w1", "w2"]

    def matrix(values: list[bytes], width: int, backwards: bool):
        size = np.array([len(v) for v in values])
        flat = np.frombuffer(b"".join(v[::-1].ljust(width, b"\0") if backwards else v.ljust(width, b"\0") for v in values), np.uint8)
        return flat.reshape(len(values), width), size

    def sort(rows):
        key, order, doc, base, left, right = zip(*rows)
        order, doc, base = np.array(order, np.int64), np.array(doc, np.int64), np.array(base, np.int64)
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((base, doc, order))] = np.arange(len(rows))
        width = max(map(len, left))
        found, step = induced_repeats(np.array(key, np.int64), rank, *matrix(left, max(width, 1), True), *matrix(right, LENGTH, False))
        zero = pa.array(np.zeros(len(found), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(order[found]), pa.array(doc[found]), pa.array(base[found] - step), pa.array(np.zeros(len(found)), pa.int32()), zero, zero], names=names)

    def single(rows):
        out: list[list] = [[], [], [], [], []]
        for _, order, doc, base, left, right in rows:
            text = left + right
            for start in range(len(text) - LENGTH + 1):
                digest = xxhash.xxh3_128_digest(text[start : start + LENGTH])
                out[0].append(order)
                out[1].append(doc)
                out[2].append(base - len(left) + start)
                out[3].append(int.from_bytes(digest[:8], "little", signed=True))
                out[4].append(int.from_bytes(digest[8:], "little", signed=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(np.ones(len(out[0])), pa.int32()), *(pa.array(c, pa.int64()) for c in out[3:])], names=names)

    ready: list = []
    group: list = []
    current, whole = None, False
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                if row[0] != current:
                    if whole and len(group) > 1:
                        ready += group
                    elif not whole and group:
                        yield single(group)
                    whole, current, group = current is not None, row[0], []
                    if len(ready) >= TUPLES:
                        yield sort(ready)
                        ready = []
                group.append(row)
                if len(group) > GROUP or (not whole and len(group) >= 1000):
                    whole = False
                    yield single(group)
                    group = []
    if group:
        yield single(group)
    if ready:
        yield sort(ready)


def _cut(batches: Iterator) -> Iterator:
    """Union of the repeated ranges of each text, and the digest of what is left."""
    import hashlib

    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            out: list[list] = [[], [], [], []]
            for packed, places in zip(part.column("z").to_pylist(), part.column("ranges").to_pylist()):
                text = unpack.decompress(packed)
                kept, removed, spans, upto = [], 0, 0, 0
                if places:
                    lo, hi, _ = _unpack(np.array(places, np.int64))
                    sort = np.argsort(lo, kind="stable")
                    lo, end = lo[sort], np.minimum(np.maximum.accumulate(hi[sort] + LENGTH), len(text))
                    first = np.flatnonzero(np.concatenate(([True], lo[1:] > end[:-1])))
                    for start, stop in zip(lo[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist()):
                        if start < stop:
                            kept.append(text[upto:start])
                            removed, spans, upto = removed + stop - start, spans + 1, stop
                kept.append(text[upto:])
                for column, value in zip(out, (len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a LENGTH-byte passage that also starts earlier.

    Earlier: smaller doc_id, or the same document and a smaller start. Passages are judged on
    the input and never cross documents.

    1. Suffixes are sampled so that each passage holds one at a place that depends on its bytes
       alone (``sampled_suffixes``), and sorted on disk over all machines by (gram, bytes of all
       passages it stands for, place). Equal neighbours settle whole runs of passages.
    2. Only tuples whose gram has several continuations need their bytes. They are sorted with
       their common prefixes, and the order of the suffixes to their left is induced byte by byte
       (``induced_repeats``). Groups that are too large or cross a partition are settled by
       keyed minima over their passages.
    3. Each text loses the union of its repeated ranges.

    Spans are compared by their gram's and their own 64-bit hash together, single passages by
    128 bits. A null text is empty; null ids come last; texts of one id, or without an id, are
    documents of their own in the order of their hash (79 bits tell them apart). Rows equal in id
    and text count as one document and get one result each; an empty table gives no rows; other columns are not read.

    Returns doc_id (as given), n_bytes, n_removed, n_spans, kept_sha256.
    """
    docs = texts(docs, id_col, text_col).select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"),
        F.xxhash64("text").alias("doc"),
        F.hash("text").cast("long").bitwiseAND(F.lit(0x7FFF)).alias("tag"),
        F.col("text").cast("binary").alias("bytes"),
    )

    def squeeze(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                z = pa.array([pack.compress(x) for x in part.column("bytes").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "ord", "doc", "tag")), z], names=["doc_id", "ord", "doc", "tag", "z"])

    squeezed_schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("ord", "doc", "tag")), T.StructField("z", T.BinaryType())])
    squeezed = docs.mapInArrow(squeeze, squeezed_schema)
    tag = F.shiftright("place", _TAG).alias("tag")

    tuples = docs.select("ord", "doc", "tag", "bytes").mapInArrow(_suffix_tuples, "gram long, span long, ord long, doc long, place long")
    by_span = ["gram", "span", "ord", "doc", "place"]
    spans = tuples.repartitionByRange(*by_span).sortWithinPartitions(*by_span).mapInArrow(_settle_spans, "gram long, ord long, doc long, place long, kind int")
    spans = staged(spans, "spans")

    needed = spans.filter("kind = 1").groupBy("ord", "doc", tag).agg(F.collect_list("place").alias("places"))
    contexts = squeezed.dropDuplicates(["ord", "doc", "tag"]).join(needed, ["ord", "doc", "tag"]).select("ord", "doc", "tag", "z", "places")
    contexts = contexts.mapInArrow(_contexts, "key long, ord long, doc long, base long, left binary, right binary")
    dealt = contexts.repartitionByRange("key", "ord", "doc", "base").sortWithinPartitions("key")
    passages = staged(dealt.mapInArrow(_settle_passages, "ord long, doc long, start long, kind int, w1 long, w2 long"), "passages")

    single = passages.filter("kind = 1")
    first = single.groupBy("w1", "w2").agg(F.min(F.struct("ord", "doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = single.join(first, ["w1", "w2"]).filter("first < struct(ord, doc, start)").select("ord", "doc", "start")

    # A passage as a place of one start: the tag lies above the start in both.
    starts = passages.filter("kind = 0").select("ord", "doc", "start").union(later)
    low = F.lit((1 << (_TAG - _PLACE)) - 1)
    starts = starts.select(
        "ord",
        "doc",
        F.shiftleft(F.shiftright("start", _TAG), _TAG).bitwiseOR(F.shiftleft(F.col("start").bitwiseAND(low), _PLACE)).alias("place"),
    )
    ranges = spans.filter("kind = 0").select("ord", "doc", "place").union(starts)
    ranges = ranges.groupBy("ord", "doc", tag).agg(F.collect_list("place").alias("ranges"))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return squeezed.join(ranges, ["ord", "doc", "tag"], "left").select("doc_id", "z", "ranges").mapInArrow(_cut, schema)
