import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from convoy.llm.packing import CapacityTree, WordEncoder, best_fit_plan, pack_best_fit
from convoy.llm.queries import tokenizer_file


def bins_by_hand(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 200])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
    plan = best_fit_plan(Counter(lengths), capacity)
    rank, used = Counter(), defaultdict(list)
    for length in lengths:
        step = [r for r in plan if r[0] == length and r[1] <= rank[length]][-1]
        nth = rank[length] - step[1]
        used[step[3] + nth // step[2]].append((step[4] + nth % step[2] * length, length))
        rank[length] += 1
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == bins_by_hand(lengths, capacity)


def test_tree_finds_the_tightest():
    tree = CapacityTree(100)
    for room in (7, 30, 99):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (0, 7, 8, 31, 100)] == [7, 7, 30, 99, None]


def test_words_encode_like_whole_texts(pairs):
    encoder = WordEncoder(tokenizer_file())
    rng = random.Random(4)
    odd = ["A", "b", "é", "́", " ", "\x1c", "\x85", "Σ", "σ", "İ", "'s", "'T", ".", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "１", "日", "K", "Ω", " ", "ﬁ", "\t", "aZ.", "क़"]
    texts = [t or "" for _, t in pairs] + ["".join(rng.choice(odd) for _ in range(8)) for _ in range(2000)]
    for text, data in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, found, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, want))
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == len(bins_by_hand([r.length for r in found], capacity))


def test_documents(documents, pairs):
    check(pairs, pack_best_fit(documents.repartition(3), tokenizer_file(), 2048).collect(), 2048)


def test_edges(edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    check(rows, pack_best_fit(edge_docs, tokenizer_file(), 300).collect(), 300)
    assert pack_best_fit(no_docs, tokenizer_file()).count() == 0
