import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from convoy.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for norm, members in groups.items():
        members.sort()
        for nth, (_, _, i) in enumerate(members):
            out.append((i, members[0][2], len(members), nth == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in exact_duplicates(df).collect()), key=str)


def test_documents(documents, pairs):
    assert got(documents) == brute(pairs)


def test_edges(edge_docs, no_docs):
    assert got(edge_docs) == brute([tuple(r) for r in edge_docs.select("doc_id", "text").collect()])
    assert exact_duplicates(no_docs).count() == 0


def test_a_group_over_many_partitions(spark):
    """One text in most rows: its run crosses every border between partitions."""
    rows = [(i, "hot  text" if i % 10 else f"own {i}") for i in range(4000)] + [(5000, "hot text  and more")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_that_stay(edge_docs, no_docs):
    rows = drop_exact_duplicates(edge_docs)
    assert rows.columns == edge_docs.columns
    kept = exact_duplicates(edge_docs).filter("kept")
    assert sorted(str(r.doc_id) for r in rows.collect()) == sorted(str(r.doc_id) for r in kept.collect())
    assert rows.filter(F.col("doc_id") == 12).count() == 1
    assert drop_exact_duplicates(no_docs).count() == 0
