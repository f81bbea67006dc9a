"""Jaccard similarity join of word n-gram sets through prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import chunks, texts
from convoy.llm.components import connected_components, merged_components
from convoy.settings import release, staged

#: Sets that one tree holds at most; a larger group is split into blocks.
BLOCK = 600
#: Sets of a component that meet those of others, and how often, before all that is open meets.
SPEAKERS, MEETINGS = 3, 1
#: Word hashes a worker remembers.
WORDS_KEPT = 300_000

# Odd multipliers and shifts of the 64-bit mixer.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one sequence of word hashes.

    A sequence of fewer words is one shingle, told apart by its length; none gives none.
    """
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h * np.uint64(MIX[0]) + words[i : len(words) - size + 1 + i])
    return np.unique(h)


def word_sets(batch: list[str], n: int, known: _WordHash) -> Iterator[np.ndarray]:
    for text in batch:
        # Bytes: lower() then changes A-Z alone and split() knows exactly the six ASCII blanks.
        words = text.encode("utf-8", "surrogatepass").lower().split()
        yield shingle_set(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), n)


class Bounds:
    """What a similarity of at least percent/100 implies for sets of given sizes.

    ``lost(n)``: tokens of a set of n that may be missing in a partner. A set shows its first
    ``shown(n)`` tokens in the order of their hashes, ``spare(n)`` more than it may lose, so
    the first ``spare`` common tokens of two partners are shown by both; at least ``common(n)``
    of the shown ones are then shared, as a partner has at least percent/100 * n tokens.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, n):
        return -(-self.percent * n // 100)

    def lost(self, n):
        return n - self.least(n)

    def spare(self, n):
        return np.maximum(1, n // 10)

    def shown(self, n):
        return np.minimum(n, self.lost(n) + self.spare(n))

    def common(self, n):
        return np.minimum(self.spare(self.least(n)), self.least(n))

    def column_common(self, n: Column) -> Column:
        least = F.ceil(n * self.percent / 100)
        return F.least(F.greatest(F.lit(1), F.floor(least / 10)), least)

    def overlap(self, a, b):
        """Smallest intersection that makes sets of sizes a and b similar."""
        return -(-self.percent * (a + b) // (100 + self.percent))


class PrefixTree:
    """Compressed trie of rank sequences; nodes know the sizes and rests below them."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sequences]
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        self.sequences, self.sizes = sequences, sizes
        self.root = self._build(0, len(self.order), 0)

    def _common(self, a: np.ndarray, b: np.ndarray, depth: int) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        return depth + int(differ[0]) if len(differ) else n

    def _build(self, low: int, high: int, depth: int):
        """A node: (segment, leaves ending here, children, smallest size, longest rest)."""
        stack, done = [(low, high, depth, None)], []
        while stack:
            low, high, depth, parent = stack.pop()
            first, last = self.sequences[self.order[low]], self.sequences[self.order[high - 1]]
            end = self._common(first, last, depth)
            below = [self.order[i] for i in range(low, high)]
            node = [first[depth:end], [], [], int(min(self.sizes[below])), max(len(self.sequences[i]) for i in below) - end, below]
            at = low
            while at < high and len(self.sequences[self.order[at]]) == end:
                node[1].append(self.order[at])
                at += 1
            while at < high:
                head, stop = self.sequences[self.order[at]][end], at + 1
                while stop < high and self.sequences[self.order[stop]][end] == head:
                    stop += 1
                stack.append((at, stop, end, node))
                at = stop
            if parent is None:
                done = node
            else:
                parent[2].append(node)
        return done


def tree_links(sets: list[np.ndarray], bounds: Bounds, linked: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all similar sets of one group, found in one tree.

    Only tokens that two sets hold enter the tree, the common ones first, so that near copies
    share long paths. A set walks down the tree with its overlap so far; a branch is left when
    the overlap plus the shorter of both rests cannot reach the bound for the smallest
    set below, and when all sets below are already connected with it. ``linked`` may give the
    components known before.
    """
    k = len(sets)
    root = list(range(k)) if linked is None else list(linked)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tokens, held = np.unique(np.concatenate(sets), return_counts=True) if k else (np.zeros(0, np.uint64), np.zeros(0, int))
    shared = np.flatnonzero(held > 1)
    by_use = shared[np.lexsort((tokens[shared], -held[shared]))]
    rank = np.full(len(tokens), -1, np.int64)
    rank[by_use] = np.arange(len(by_use))
    sequences = []
    for s in sets:
        r = rank[np.searchsorted(tokens, s)]
        sequences.append(np.sort(r[r >= 0]))
    sizes = np.array([len(s) for s in sets])
    alive = [i for i in range(k) if len(sequences[i]) >= bounds.least(sizes[i])]
    if len(alive) < 2:
        return []
    tree = PrefixTree([sequences[i] for i in alive], sizes[alive])
    mask, links = np.zeros(len(by_use), bool), []
    for x, own in enumerate(alive):
        mask[sequences[own]] = True
        size, total = int(sizes[own]), len(sequences[own])
        stack = [(tree.root, 0)]
        while stack:
            (segment, leaves, children, smallest, rest, below), overlap = stack.pop()
            here = find(own)
            if all(find(alive[i]) == here for i in below):
                continue
            overlap += int(np.count_nonzero(mask[segment]))
            if overlap + min(rest, total - overlap) < bounds.overlap(size, max(smallest, bounds.least(size))):
                continue
            for leaf in leaves:
                other = alive[leaf]
                if find(other) != find(own) and overlap >= bounds.overlap(size, int(sizes[other])):
                    links.append((own, other))
                    low, high = sorted((find(own), find(other)))
                    root[high] = low
            stack.extend((child, overlap) for child in children)
        mask[sequences[own]] = False
    return links


def _groups(batches: Iterator, keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of sorted batches by their first ``keys`` columns, one group alive at a time."""
    current, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:keys] != current:
                if rows:
                    yield current, rows
                current, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def _stars(links: list[tuple[int, int]], nodes: list[str]) -> dict[str, str]:
    """The smallest member of its component for every other node of the links."""
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = i = parent.get(parent[i], parent[i])
        return i

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            low, high = (a, b) if nodes[a] < nodes[b] else (b, a)
            parent[high] = low
    return {nodes[i]: nodes[top(i)] for i in parent}


def _links_of(groups: DataFrame, bounds: Bounds) -> DataFrame:
    """Links (a, b) of rows (group, block, node, root, tokens), one tree for each (group, block).

    The links found in a tree are handed on as stars: each set with the smallest it reaches there.
    """

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, rows in _groups(batches, 2):
            unique = {node: (root, tokens) for node, root, tokens in rows}
            nodes = list(unique)
            first: dict[str, int] = {}
            linked = [first.setdefault(unique[node][0], i) for i, node in enumerate(nodes)]
            stars = _stars(tree_links([np.frombuffer(unique[node][1], np.uint64) for node in nodes], bounds, linked), nodes)
            if stars:
                yield pa.RecordBatch.from_arrays([pa.array(list(stars)), pa.array(list(stars.values()))], names=["a", "b"])

    dealt = groups.select("group", "block", "node", "root", "tokens").repartition("group", "block").sortWithinPartitions("group", "block")
    return dealt.mapInArrow(join, "a string, b string")


def jaccard_components(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose n-word shingle sets have a Jaccard similarity of percent/100.

    1. Equal sets become one node. Each node shows its first tokens in the order of their
       hashes (``Bounds``); a node with too few shown tokens that occur elsewhere has no partner.
    2. Of the shown tokens of the rest, the rarest are its prefix; two similar sets share a prefix
       token. All sets of a token meet in the group of the smallest of them, so near copies
       meet in few groups.
    3. Every group, in blocks of ``BLOCK`` sets that all hold its smallest set, is joined in a prefix
       tree (``tree_links``). Where a group of several blocks is not yet one component, a few sets
       of each component meet first; then every set outside the largest one meets all others.
    4. Links become components; members of a node follow it.

    Shingles are compared by 64-bit hashes, sets by 128 bits. Null and empty texts have no
    shingles and are alone, a text of fewer than n words is one shingle, repeated rows are equal
    sets, an empty table gives no rows, other columns are not read.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable).
    """
    bounds = Bounds(percent)
    docs = texts(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType

    def show(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        known = _WordHash()
        for ids, batch in chunks(batches):
            nodes, sizes, shown = [], [], []
            for s in word_sets(batch, n, known):
                nodes.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                shown.append(s[: int(bounds.shown(len(s)))].view(np.int64) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in shown]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(shown) if shown else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "node", "n", "shown"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("node", T.StringType()), T.StructField("n", T.LongType()), T.StructField("shown", T.ArrayType(T.LongType()))])
    sets = staged(docs.mapInArrow(show, schema), "shown")

    # Equal sets show equal tokens, so any of them will do.
    firsts = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("shown").alias("shown"))
    firsts = staged(firsts.withColumn("tag", F.xxhash64("node")), "firsts")
    # Tables with tokens are large; each goes when it has been read for the last time.
    members, nodes = staged(sets.drop("shown"), "members"), staged(firsts.select("node", "doc_id"), "nodes")
    release(sets)
    candidates = _prefixes(firsts.select("node", "tag", "n", "shown"), bounds)
    release(firsts)
    routes = staged(_routes(candidates), "routes")
    release(candidates)

    wanted = routes.select("node").distinct().join(nodes, "node").select("doc_id", "node")
    whole = staged(_tokens(docs.join(wanted, "doc_id"), n), "tokens")
    tokens = whole.dropDuplicates(["node"])

    links = staged(_links_of(routes.withColumn("root", F.col("node")).join(tokens, "node"), bounds), "links")
    roots = connected_components(links)
    release(links)
    several = routes.filter("blocks > 1")
    if not several.isEmpty():
        roots = _across_blocks(several, roots, tokens, bounds)
    release(whole, routes)

    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "root").select("node", "component_id")
    return members.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _prefixes(firsts: DataFrame, bounds: Bounds) -> DataFrame:
    """(token, node): the rarest shown tokens of the nodes that may have a partner."""

    def shared(batches: Iterator) -> Iterator:
        """Nodes of tokens that are not alone; at the ends of a partition a token may go on elsewhere."""
        import pyarrow as pa

        waiting: np.ndarray | None = None
        last, edge = None, True
        for batch in batches:
            token, node = batch.column("token").to_numpy(), batch.column("tag").to_numpy()
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            left = np.concatenate(([edge or token[0] == last], same))
            right = np.concatenate((same, [False]))
            out = [node[:-1][(left | right)[:-1]]]
            if waiting is not None and token[0] == last:
                out.append(waiting)
            waiting = None
            if left[-1]:
                out.append(node[-1:])
            else:
                waiting = node[-1:]
            last, edge = token[-1], False
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["tag"])
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array(waiting)], names=["tag"])

    rows = firsts.select(F.explode("shown").alias("token"), "tag").repartitionByRange("token", "tag").sortWithinPartitions("token")
    counts = rows.mapInArrow(shared, "tag long").groupBy("tag").agg(F.count(F.lit(1)).alias("shared"))
    kept = firsts.join(counts, "tag").filter(F.col("shared") >= bounds.column_common(F.col("n"))).select("node", "n", "shown")
    kept = staged(kept, "kept")

    rows = kept.select("node", F.explode("shown").alias("token"))
    used = rows.groupBy("token").agg(F.count(F.lit(1)).alias("used")).filter("used > 1")
    ranked = rows.join(used, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("used", "token"))).alias("by_use"))
    alone = F.size("shown") - F.size("by_use")
    length = F.size("shown") - bounds.column_common(F.col("n")) + 1 - alone
    found = (
        kept.join(ranked, "node")
        .withColumn("length", length.cast("int"))
        .filter("length > 0")
        .select("node", F.explode(F.slice("by_use", F.lit(1), F.col("length"))).alias("t"))
        .select("node", F.col("t.token").alias("token"))
    )
    found = staged(found, "prefixes")
    release(kept)
    return found


def _routes(prefixes: DataFrame) -> DataFrame:
    """(group, node, block, blocks): the groups a node goes to, each named by its smallest node."""
    heads = prefixes.groupBy("token").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("used")).filter("used > 1")
    routes = prefixes.join(heads.select("token", "group"), "token").select("group", "node").distinct()
    sizes = routes.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    routes = routes.join(sizes, "group").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    others = routes.filter("node <> group").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    heads = routes.filter("node = group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return others.unionByName(heads).select("group", "node", "block", "blocks")


def _tokens(docs: DataFrame, n: int) -> DataFrame:
    """(node, tokens): the whole set of every wanted node."""

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        known = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.tobytes() for s in word_sets(part.column("text").to_pylist(), n, known)]
                # An id may be repeated with another text.
                own = [(node, s) for node, s in zip(part.column("node").to_pylist(), sets) if xxhash.xxh3_128_hexdigest(s) == node]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([x for _, x in own], pa.binary())], names=["node", "tokens"])

    return docs.select("node", "text").mapInArrow(whole, "node string, tokens binary")


def _members(routes: DataFrame, roots: DataFrame) -> DataFrame:
    """(group, node, blocks, root): the sets of groups that are not yet one component."""
    members = routes.select("group", "node", "blocks").distinct().join(roots, "node", "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    open_groups = members.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return staged(members.join(open_groups.select("group"), "group", "left_semi"), "members")


def _across_blocks(routes: DataFrame, roots: DataFrame, tokens: DataFrame, bounds: Bounds) -> DataFrame:
    """Components of the groups of several blocks, from those found within blocks.

    First a few sets of every component meet those of the others, dealt anew each time: blocks
    of one family, whose smallest set is not like the rest, so grow together in rows that
    are linear in the sets. Then every set outside the largest component meets every other.
    """
    members = _members(routes, roots)
    for turn in range(MEETINGS):
        nth = F.row_number().over(Window.partitionBy("group", "root").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
        few = members.withColumn("nth", nth).filter(F.col("nth") <= SPEAKERS)
        counts = few.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        few = few.join(counts, "group").select("group", F.expr(f"cast(pmod(xxhash64(node, {turn + 7}), parts) as int)").alias("block"), "node", "root")
        earlier, roots = roots, merged_components(roots, _links_of(few.join(tokens, "node"), bounds))
        if roots is not earlier:
            release(members)
            members = _members(routes, roots)

    parts = members.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy(F.col("n").desc(), "root")))
    outside = members.join(parts.filter("nth > 1").select("group", "root"), ["group", "root"])
    rows = outside.groupBy("group").agg((F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("rows"))
    # A task is (row block of the sets outside, column block of all sets).
    outside = outside.join(rows, "group").select(
        "group", "node", "root", F.expr("cast(pmod(xxhash64(node, 1), rows) as int)").alias("row"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("column")
    )
    inside = members.join(rows, "group").select(
        "group", "node", "root", F.explode(F.expr("sequence(0, rows - 1)")).alias("row"), F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("column")
    )
    tasks = outside.unionByName(inside).select("group", F.concat_ws(":", "row", "column").alias("block"), "node", "root")
    roots = merged_components(roots, _links_of(tasks.join(tokens, "node"), bounds))
    release(members)
    return roots


def drop_near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows of the smallest id of each component, one for each text of that id.

    Rows without an id stay where no other document is in their component.
    """
    found = jaccard_components(docs, percent, n, id_col, text_col)
    kept = found.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_id"]), "left_semi").dropDuplicates([id_col, text_col])
