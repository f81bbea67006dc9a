import random

import numpy as np
import pytest

from convoy.llm.decontaminate import PassageIndex, _WordHash, benchmark_passages, drop_contaminated, edit_distance, word_hashes


def by_hand(item, region):
    rows = [[0] * (len(region) + 1)]
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(region, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a != b)))
        rows.append(row)
    return min(rows[-1])


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        assert edit_distance(a, b) == by_hand(a.tolist(), b.tolist())


def planted(make_prose, rate, seed, words=30):
    """Items, texts with one edited item each, and the item in each."""
    rng = random.Random(seed)
    items = [(i, make_prose(3000 + i, rng.randint(words, words + 20))) for i in range(40)]
    texts, want = [], []
    for i, text in items * 3:
        parts = text.split()
        for _ in range(int(rate * len(parts))):
            k, how = rng.randrange(len(parts)), rng.randrange(3)
            if how == 0:
                parts[k] = "other"
            elif how == 1 and len(parts) > 3:
                del parts[k]
            else:
                parts.insert(k, "added")
        texts.append(" ".join([make_prose(rng.randrange(10**6), 40), *parts, make_prose(rng.randrange(10**6), 40)]))
        want.append(i)
    return items, texts, want


@pytest.mark.parametrize("rate,words,least", [(0.0, 30, 1.0), (0.1, 30, 0.99), (0.2, 30, 0.95), (0.0, 4, 1.0), (0.0, 1, 1.0)])
def test_recall_of_planted_items(make_prose, rate, words, least):
    items, texts, want = planted(make_prose, rate, 7, words)
    known = _WordHash()
    index = PassageIndex([(i, word_hashes(t, known)) for i, t in items], 0.8)
    found = {(d, index.items[i][0]) for d, i, _ in index.search(texts, known)}
    assert sum((d, i) in found for d, i in enumerate(want)) >= least * len(want)


def test_pairs_against_brute_force(spark, make_prose):
    """Recall of at least 0.9 over all pairs of texts and items, and no false pair."""
    items, texts, _ = planted(make_prose, 0.15, 11)
    known = _WordHash()
    words = [word_hashes(t, known) for t in texts]
    want = {}
    for i, t in items:
        target = word_hashes(t, known)
        for d, w in enumerate(words):
            x = edit_distance(target, w)
            if x <= int(0.2 * len(target) + 1e-9):
                want[d, i] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in benchmark_passages(docs, bench).collect()}
    assert set(found) <= set(want) and len(found) >= 0.9 * len(want)
    assert all(found[k] == want[k] for k in found)
    left = {r.doc_id for r in drop_contaminated(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in found}


def test_documents(documents, pairs, sf, spark):
    """Every document that holds a whole item word for word is found."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    exact = {(d, i) for d, t in pairs for i, x in items if x and x in " ".join((t or "").split())}
    found = {(r.doc_id, r.item_id) for r in benchmark_passages(documents, bench).collect()}
    assert exact <= found


def test_passes_and_edges(spark, edge_docs, no_docs, monkeypatch, make_prose):
    rows = [(1, make_prose(2, 120)), (2, None), (3, ""), (4, "...!"), (5, "two words"), (5, "two words"), (None, make_prose(4, 200))]
    bench = spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")
    whole = sorted(map(str, benchmark_passages(edge_docs, bench).collect()))
    pairs = {(r.doc_id, r.item_id) for r in benchmark_passages(edge_docs, bench).collect()}
    assert {(1, 1), (7, 1), (8, 1), (9, 1), (10, 5), (11, 5), (14, None), (15, None)} <= pairs
    from convoy.llm import decontaminate

    monkeypatch.setattr(decontaminate.passage_indexes, "__defaults__", (2,))
    assert sorted(map(str, benchmark_passages(edge_docs, bench).collect())) == whole
    kept = drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and {2, 3, 4, 5, 6} <= {r.doc_id for r in kept.collect()}
    assert benchmark_passages(no_docs, bench).count() == 0
    assert benchmark_passages(edge_docs, spark.createDataFrame([], bench.schema)).count() == 0
    assert drop_contaminated(edge_docs, spark.createDataFrame([], bench.schema)).count() == edge_docs.count()
