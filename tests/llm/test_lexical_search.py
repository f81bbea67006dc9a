import math
import re
from collections import Counter

import pytest

from convoy.llm.lexical_search import ItemTerms, ranked_documents, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        wanted, scored = set(words(text)), []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // max(n_all, 1)
            score = 0
            for t in wanted & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got(df, benchmark, **options):
    return sorted((tuple(r)[:4] for r in ranked_documents(df, benchmark, **options).collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


@pytest.fixture(scope="module")
def items(benchmark):
    return [(r["item_id"], r["text"]) for r in benchmark.collect()]


def test_documents(documents, pairs, benchmark, items):
    assert got(documents, benchmark) == brute(pairs, items)


def test_passes_give_the_same(documents, pairs, benchmark, items):
    assert got(documents, benchmark, top=3, items_per_pass=7) == brute(pairs, items, 3)
    assert got(documents, benchmark, top=3, bytes_per_pass=2000) == brute(pairs, items, 3)


def test_edges(spark, edge_docs, no_docs, benchmark):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    wanted = [(1, "The river stone, the RIVER"), (2, None), (3, ""), (4, "- ."), (5, "no such words qq"), (6, "two words é"), (6, "copper light"), (None, "birds")]
    asked = spark.createDataFrame([(*w, "x") for w in wanted], "item_id long, text string, rank string")
    for top in (2, 50):
        assert got(edge_docs, asked, top=top) == brute(rows, wanted, top)
    lists = {(r["item_id"], r["item"]) for r in ranked_documents(edge_docs, asked).collect()}
    assert sum(item == 6 for item, _ in lists) == 2
    assert ranked_documents(no_docs, asked).count() == 0
    assert ranked_documents(edge_docs, asked.limit(0)).count() == 0
    with pytest.raises(TypeError):
        ranked_documents(edge_docs.selectExpr("text AS doc_id", "text"), asked)


def test_ties_and_cuts(spark, monkeypatch):
    """Thousands of equal scores, cut again and again: the smallest ids win."""
    import convoy.llm.lexical_search as module

    monkeypatch.setattr(module, "CANDIDATES", 20)
    best = module._Best(2, 3)
    import numpy as np

    for start in (5000, 100, 3000, 0):
        scores = np.array([[7, k % 5] for k in range(90)])
        best.add(scores, np.arange(start, start + 90), np.zeros(90, bool))
    item, score, _, ids = best.cut()
    assert list(zip(item, score, ids)) == [(0, 7, 0), (0, 7, 1), (0, 7, 2), (1, 4, 4), (1, 4, 9), (1, 4, 14)]
    rows = [(k, "same text here") for k in range(3000)] + [(k, "other words") for k in range(3000, 9000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    asked = spark.createDataFrame([("a", "text")], "item_id string, text string")
    found = ranked_documents(df, asked)
    assert found.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted((r["rank"], r["doc_id"]) for r in found.collect()) == [(k + 1, k) for k in range(50)]


def test_guards_keep_to_whole_terms():
    index = ItemTerms([(1, {b"a", b"ab"}), (2, {"é".encode()})])
    n, found = index.count("a ab,a-A aab é éa a b")
    assert n == 9
    assert sorted(found.values()) == [1, 1, 4]
    assert terms("It's 2x É\x00_b") == [b"it", b"s", b"2x", "É".encode(), b"b"]
