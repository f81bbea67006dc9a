import hashlib
import random

import numpy as np
import pytest

from convoy.llm import suffix_dedup
from convoy.llm.suffix_dedup import LENGTH, induced_repeats, remove_repeats, sampled_suffixes


def brute(rows, length=LENGTH):
    """Rows equal in id and text are one document; null ids are last."""
    seen, out = set(), {}
    for i, text in sorted(set((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0])):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(data[p : p + length])
        spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out[i, text] = (len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest())
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in remove_repeats(df).collect()), key=str)


def passages(seed, docs=60):
    """Texts of shared pieces of many lengths, so that repeats start and end anywhere."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([5, 40, 75, 99, 100, 101, 180, 400]))) for _ in range(12)]
    return [(i, "".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice("uvwxyz") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8)))) for i in range(docs)]


def test_documents(documents, pairs):
    assert got(documents) == brute(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_pieces(spark, seed):
    rows = passages(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_small_groups_and_tiles(spark, monkeypatch):
    """Groups over the bound are settled by minima, texts over a tile are cut into tiles."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "TILE", 150)
    rows = passages(3) + [(900, "ab" * 700), (901, "ab" * 60), (902, "z" * 300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_edges(edge_docs, no_docs):
    assert got(edge_docs) == brute([tuple(r) for r in edge_docs.select("doc_id", "text").collect()])
    assert remove_repeats(no_docs).count() == 0


def test_thousands_of_rows_without_or_with_one_id(spark):
    """Different texts without an id, or of one id, are documents of their own, in the order of their hash."""
    shared = passages(7, 3_000)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ghijklm ") for _ in range(rng.randint(1, 140))) + t for _, t in shared]
    rows = [(None if k % 3 else 5 if k % 2 else k, t) for k, t in enumerate(texts)] + [(None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").distinct().collect()}
    # Numbers in the place of ids, in the order of the documents.
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    number = {r: n for n, r in enumerate(order)}
    want = brute([(number[r], r[1]) for r in rows])
    assert got(docs.repartition(3)) == sorted(((order[w[0]][0], *w[1:]) for w in want), key=str)


def test_every_passage_has_its_anchor():
    rng = np.random.default_rng(5)
    shared = rng.integers(97, 100, 260).astype(np.uint8)
    data = np.concatenate((rng.integers(97, 123, 333).astype(np.uint8), shared, rng.integers(97, 123, 77).astype(np.uint8), shared))
    text, lo, hi, anchor, gram, span = sampled_suffixes(data, np.array([0]), np.array([len(data)]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert covered.tolist() == list(range(len(data) - LENGTH + 1))
    place = {int(p): int(a - p) for a, b, x in zip(lo, hi, anchor) for p in range(a, b + 1) for a in [x]}
    first, second = 333, 333 + 260 + 77
    assert [place[first + k] for k in range(161)] == [place[second + k] for k in range(161)]


@pytest.mark.parametrize("seed", range(10))
def test_induced_order_finds_equal_passages(seed):
    rng = np.random.default_rng(seed)
    n, width = 60, 12
    pool = rng.integers(97, 99, (6, width + LENGTH)).astype(np.uint8)
    rows = pool[rng.integers(0, 6, n)].copy()
    rows[rng.random(rows.shape) < 0.004] = 120
    left_size, right_size = rng.integers(0, width + 1, n), rng.integers(LENGTH - width, LENGTH + 1, n)
    key, order = rng.integers(0, 2, n), rng.permutation(n)
    left = rows[:, :width][:, ::-1].copy()
    right = rows[:, width:].copy()
    right[np.arange(LENGTH) >= right_size[:, None]] = 0
    found = set(zip(*(a.tolist() for a in induced_repeats(key, order, left, left_size, right, right_size))))
    want = set()
    for step in range(width + 1):
        seen = {}
        for i in np.argsort(order):
            if left_size[i] >= step and right_size[i] + step >= LENGTH:
                text = (int(key[i]), rows[i, width - step : width - step + LENGTH].tobytes())
                if text in seen:
                    want.add((int(i), step))
                seen[text] = i
    assert found == want
