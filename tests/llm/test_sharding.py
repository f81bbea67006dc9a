import zlib

from convoy.llm.sharding import shard_by_bytes


def check(rows, found, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    total = sum(r.size for r in found)
    most = max(r.size for r in found)
    for shard in range(shards):
        own = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= most
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in found)


def test_shards_are_near_equal(documents, pairs):
    check(pairs, shard_by_bytes(documents, 7).collect(), 7)


def test_equal_texts_are_neighbours(spark):
    rows = [(i, f"text {i % 3}") for i in range(300)]
    found = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    check(rows, found, 40)
    shards_of = {t: {r.shard for r in found if r.text_crc32 == zlib.crc32(t.encode())} for t in ("text 0", "text 1", "text 2")}
    assert sum(map(len, shards_of.values())) <= 40 + 2


def test_edges(edge_docs, edge_rows, no_docs):
    found = shard_by_bytes(edge_docs, 3).collect()
    check([(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()], found, 3)
    assert len(found) == len(edge_rows) + 1
    assert shard_by_bytes(no_docs).count() == 0
