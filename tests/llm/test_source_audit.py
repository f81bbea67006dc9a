import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from convoy.llm.source_audit import PerfectShards, perfect_hash, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs=3, top=200):
    held, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        held[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
    out = []
    for lang, names in sources.items():
        kept = [t for t, d in held[lang].items() if d >= min_docs]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in names}
        share = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in names}
        whole = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in names) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        for s in names:
            pairs = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in names if o != s]
            own = [((share[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and share[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", own)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in source_divergence(df, **options).collect())


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("lang", "source", "text").collect()]
    assert got(documents) == brute(rows)


def test_many_shards_passes_and_blocks(documents):
    """The result does not depend on how shards, passes and blocks are cut."""
    rows = [tuple(r) for r in documents.select("lang", "source", "text").collect()]
    small = got(documents, top=7, shard_keys=100, pass_keys=900, block_cells=300)
    assert small == brute(rows, top=7)
    assert got(documents, top=7, shard_keys=150, pass_keys=10**6, pass_bytes=3000) == small


def test_edges(spark, edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("lang", "source", "text").collect()]
    assert got(edge_docs, min_docs=1) == brute(rows, 1)
    assert source_divergence(no_docs).count() == 0
    odd = [(None, None, "Zebra zebra É\x00x"), ("", "a", "zebra  É"), ("", "b", None), ("x", "a", ""), ("x", None, None), ("y", "only", "one two one")]
    odd += [("", "a", "zebra-crossing 12zebra"), ("", "\U0001f600", "zebra ￿ \U00010000"), ("y", "only", "one two"), ("y", "only", "two one")] * 3
    df = spark.createDataFrame(odd, "lang string, source string, text string").repartition(4)
    assert got(df) == brute(odd)
    assert got(df, min_docs=100) == brute(odd, 100)


def test_ties_at_the_last_rank_and_a_hot_source(spark):
    rng = random.Random(3)
    rows = [("en", f"s{i % 5}" if i % 3 else "hot", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in rng.sample(range(300), 40))) for i in range(240)]
    rows += [("en", "s1", " ".join(f"tie{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(260)))] * 3
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    want = brute(rows, top=50)
    assert got(df, top=50, shard_keys=64) == want
    assert len({v for _, s, part, _, v, _ in want if s == "s1" and part == "term"}) < 50


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, np.int64)).astype(np.uint64)
    bits, sizes, slot = perfect_hash(keys)
    assert sorted(slot) == list(range(len(keys))) and bits.sum() == len(keys) and sizes.sum() == len(bits)


def test_words_that_are_not_stored_are_not_counted():
    """A perfect hash gives any word a slot; the stored key tells whether it is its own."""
    from convoy.llm.source_audit import _hashes, _shard

    kept = [f"w{i}".encode() for i in range(500)]
    rows = []
    for shard in range(3):
        terms = [t for t, s in zip(kept, _shard(_hashes(kept), 3)) if s == shard]
        bits, sizes, slot = perfect_hash(_hashes(terms, shard))  # shards 1 and 2 as after equal hashes
        ordered = [terms[i] for i in np.argsort(slot)]
        ends = np.cumsum([len(t) for t in ordered])
        rows.append(
            {"lang": "en", "shard": shard, "shards": 3, "n": len(terms), "seed": shard, "bits": np.packbits(bits).tobytes()}
            | {"sizes": sizes.tobytes(), "keys": b"".join(ordered), "ends": ends.astype(np.int64).tobytes()}
        )
    shards = PerfectShards(rows)
    slots = shards.slots("en", kept)
    assert sorted(slots) == list(range(500))
    assert [shards.keys[int(k)].as_py() for k in slots] == kept
    assert set(shards.slots("en", [f"other{i}".encode() for i in range(3000)])) == {-1}
    part = PerfectShards(rows[1:2])
    assert sum(k >= 0 for k in part.slots("en", kept)) == rows[1]["n"]
