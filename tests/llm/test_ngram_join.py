import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from convoy.llm import ngram_join
from convoy.llm.components import connected_components
from convoy.llm.ngram_join import Bounds, drop_near_duplicates, jaccard_components, tree_links


def sets_of(rows, n):
    out = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        size = min(n, len(words))
        out.append((i, frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else frozenset()))
    return out


def brute(rows, percent, n):
    sets = sets_of(rows, n)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        s, t = sets[a][1], sets[b][1]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            root[find(b)] = find(a)
    names = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        names[find(k)].append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in names.items()}
    return sorted(((i, len(s), smallest[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def got(df, percent, n):
    return sorted((tuple(r) for r in jaccard_components(df, percent, n).collect()), key=str)


@pytest.mark.parametrize("percent,n", [(90, 3), (60, 2)])
def test_documents(documents, pairs, percent, n):
    assert got(documents, percent, n) == brute(pairs, percent, n)


def test_edges(edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(edge_docs, 80, 5) == brute(rows, 80, 5)
    assert jaccard_components(no_docs).count() == 0
    kept = drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(i) for i, _, c in brute(rows, 80, 5) if i == c})


def test_a_family_larger_than_a_block(spark, monkeypatch):
    """Near copies of one text, chained so that not all are alike, in blocks of six."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(80)] = f"v{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, n in ((90, 3), (75, 1)):
        assert got(df, percent, n) == brute(rows, percent, n)


@pytest.mark.parametrize("seed", range(30))
def test_tree_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(25)]
    percent = int(rng.choice([50, 70, 90]))
    links = tree_links(sets, Bounds(percent))
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
    rows = [(i, " ".join(map(str, s))) for i, s in enumerate(sets)]
    root = {i: c for i, _, c in brute(rows, percent, 1)}
    mine = list(range(25))

    def find(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        mine[high] = low
    assert {i: find(i) for i in range(25)} == root


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 60)] + [("x", "x"), ("b", None), ("p", "q")]
    rows = connected_components(spark.createDataFrame(chain, "a string, b string")).collect()
    assert {r.node: r.root for r in rows} == {f"{i:03d}": "000" for i in range(61)} | {"x": "x", "p": "p", "q": "p"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
